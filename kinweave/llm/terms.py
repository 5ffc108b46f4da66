"""Frequencies of all terms of a collection, and how characteristic a term is of a record.

Common to all functions: a term is an entry without surrounding white space and in lower case; null and blank entries don't count. A
record counts once, however often it was delivered, and not at all without an id. Records whose list is null don't belong to the collection;
records with an empty list do. Empty tables give empty results. Further columns of the table are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import lookup, materialize, once

#: Heavy terms are counted in local arrays; there are at most so many, of at most so many bytes.
HEAVY, HEAVY_BYTES = 1024, 256
BLANK = " \t\n\r\f\x0b 　"


def records(df: DataFrame, id: str = "record_id", terms: str = "terms") -> DataFrame:
    """Columns id and terms (never null), a row a record. If deliveries differ, the least list counts."""
    df = df.select(F.col(id).alias("id"), F.col(terms).alias("terms")).where(F.col("terms").isNotNull())
    return once(df, "id", "terms")


def postings(recs: DataFrame) -> DataFrame:
    """Columns id, term and tf, the number of the term's occurrences in the record; from the result of records()."""
    term = F.lower(F.btrim(F.col("entry"), F.lit(BLANK)))
    each = recs.select("id", F.explode("terms").alias("entry")).select("id", term.alias("term"))
    return each.where(F.col("term").isNotNull() & (F.col("term") != "")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _count(terms: pa.Array, tf: pa.Array) -> pa.Table:
    return pa.table({"term": terms, "occurrences": tf}).group_by("term").aggregate([("occurrences", "sum"), ("term", "count")]).rename_columns(["term", "occurrences", "n_records"])


def heavy_terms(posts: DataFrame, size: int = HEAVY) -> list[str]:
    """At most `size` terms that are frequent, for counting apart. Which they are doesn't affect any count.

    Each partition keeps `size` counters (of each merge's counts the largest stay, less the largest that goes), so that any term with
    over 1 / size of a partition's postings is among them; the terms with most votes over all partitions are taken.
    """

    def votes(batches):
        kept: pa.Table | None = None
        for b in batches:
            t = b.column("term")
            t = t.filter(pc.less_equal(pc.binary_length(t), HEAVY_BYTES))
            t = pa.table({"term": t, "n": pa.array(np.ones(len(t), np.int64))})
            t = (pa.concat_tables([kept, t]) if kept is not None else t).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
            if len(t) > size:
                n = t.column("n").to_numpy()
                cut = np.partition(n, len(n) - size - 1)[len(n) - size - 1]
                t = t.set_column(1, "n", pa.array(n - cut)).filter(pa.array(n > cut))
            kept = t
        if kept is not None and len(kept):
            yield from kept.select(["term", "n"]).to_batches()

    found = posts.select("term").mapInArrow(votes, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(r["term"] for r in found.orderBy(F.desc("n"), "term").limit(size).collect())


def term_counts(posts: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """Columns term, occurrences and n_records: exact counts over all postings.

    Postings of heavy terms are added up in a counter array of each task, which sends one row a term when it ends. Only
    the remaining terms are shuffled, counted by batch before. Both tables of counts are united, having no term in common.
    """
    heavy = heavy_terms(posts) if heavy is None else heavy

    def count(batches):
        known = pa.array(heavy, pa.string())
        n, occurrences = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for b in batches:
            terms, tf = b.column("term").cast(pa.string()), b.column("tf")
            at = pc.index_in(terms, known)
            mask = pc.is_valid(at)
            where = at.filter(mask).to_numpy(zero_copy_only=False).astype(np.int64)
            n += np.bincount(where, minlength=len(heavy))
            occurrences += np.bincount(where, weights=tf.filter(mask).to_numpy(zero_copy_only=False), minlength=len(heavy)).astype(np.int64)
            rest = pc.invert(mask)
            light = _count(terms.filter(rest), tf.filter(rest))
            yield from light.append_column("heavy", pa.array(np.zeros(len(light), bool))).select(["term", "occurrences", "n_records", "heavy"]).to_batches()
        seen = np.flatnonzero(n)
        yield pa.record_batch({"term": known.take(pa.array(seen)), "occurrences": pa.array(occurrences[seen]), "n_records": pa.array(n[seen]), "heavy": pa.array(np.ones(len(seen), bool))})

    parts = posts.select("term", "tf").mapInArrow(count, "term string, occurrences long, n_records long, heavy boolean")
    return parts.groupBy("heavy", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records")).drop("heavy")


def term_frequencies(df: DataFrame, id: str = "record_id", terms: str = "terms", rare: int = 2, common: float = 0.05) -> DataFrame:
    """Columns term, occurrences, n_records, frequency (n_records over the number of records) and mark.

    The mark is "rare" up to `rare` records, "common" above the share `common` of all records (a term that is both counts as rare), else null.
    """
    recs = records(df, id, terms)
    total = recs.agg(F.count("*").alias("n_all"))
    counts = term_counts(materialize(postings(recs))).crossJoin(F.broadcast(total))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.col("n_all") * common, "common")
    return counts.select("term", "occurrences", "n_records", (F.col("n_records") / F.col("n_all")).alias("frequency"), mark.alias("mark"))


def _idf(kind: str, n: Column, n_all: Column) -> Column:
    if kind == "plain":
        return F.log(n_all / n)
    if kind == "probabilistic":
        return F.log(1 + (n_all - n + 0.5) / (n + 0.5))
    raise ValueError(f"idf is 'plain' or 'probabilistic', not {kind!r}")


def relevance(df: DataFrame, id: str = "record_id", terms: str = "terms", k1: float = 1.2, b: float = 0.75, idf: str = "probabilistic", least_records: int = 1) -> DataFrame:
    """How characteristic each term of a record is: columns {id}, term, tf, n_records and score.

    score = idf · tf · (k1 + 1) / (tf + k1 · (1 - b + b · length / mean length)), with idf "probabilistic" ln(1 + (N - n + 0.5) / (n + 0.5)) or
    "plain" ln(N / n). N counts the collection's records, n those with the term; lengths count occurrences of terms; the mean is over all N.
    With k1 infinite the saturation is gone and the factor is tf (in the limit, for b = 0). Terms of under `least_records` records have no row.
    Terms in very many records meet their counts by a broadcast of at most 10,000 terms, the others by a shuffle.
    """
    if not k1 >= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, b must lie from 0 to 1")
    if math.isinf(k1) and b:
        raise ValueError("with an infinite k1, b must be 0")
    recs = records(df, id, terms)
    posts = materialize(postings(recs))  # read for the counts, the sums and both ways to meet the counts
    counts = materialize(term_counts(posts).where(F.col("n_records") >= least_records))
    sums = posts.agg(F.sum("tf").alias("length_all"), F.count("*").alias("postings_all"))
    total = F.broadcast(recs.agg(F.count("*").alias("n_all")).crossJoin(F.broadcast(sums)))
    hot = counts.crossJoin(total).where(F.col("n_records") * 10_000 > F.col("postings_all")).select("term")
    if not math.isinf(k1):
        lengths = posts.groupBy("id").agg(F.sum("tf").alias("length"))
        posts = posts.join(lengths, "id")
    scored = lookup(posts, counts.select("term", "n_records"), "term", hot=hot).crossJoin(total)
    weight = _idf(idf, F.col("n_records"), F.col("n_all"))
    gain = F.col("tf").cast("double")
    if not math.isinf(k1):
        relative = F.col("length") * F.col("n_all") / F.col("length_all")
        gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * relative))
    return scored.select(F.col("id").alias(id), "term", "tf", "n_records", (gain * weight).alias("score"))


def most_characteristic(scores: DataFrame, id: str = "record_id", digits: int = 9) -> DataFrame:
    """Of each record the term with the highest score rounded to `digits`; among equals the first by its UTF-8 bytes. Columns {id}, term, score."""
    ranked = scores.select(id, F.struct((-F.round("score", digits)).alias("s"), F.col("term").alias("term")).alias("best"))
    return ranked.groupBy(id).agg(F.min("best").alias("best")).select(id, F.col("best.term").alias("term"), (-F.col("best.s")).alias("score"))
