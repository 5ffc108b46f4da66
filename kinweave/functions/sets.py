"""Sets and bags of terms in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import lookup


def jaccard(a: Column, b: Column) -> Column:
    """Share of the common elements among all; 0 without a common one, null for null."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(common == 0, F.lit(0.0)).otherwise(common / F.size(F.array_union(a, b)))


def document_counts(df: DataFrame, terms: str) -> DataFrame:
    """Columns term and n_records, the number of rows whose array holds the term."""
    each = df.select(F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull())
    return each.groupBy("term").agg(F.count("*").alias("n_records"))


def term_idf(df: DataFrame, terms: str) -> DataFrame:
    """Columns term and idf, ln(N / n): N rows have an array, n of them the term."""
    total = df.where(F.col(terms).isNotNull()).agg(F.count("*").alias("n_all"))
    return document_counts(df, terms).crossJoin(F.broadcast(total)).select("term", F.log(F.col("n_all") / F.col("n_records")).alias("idf"))


def _counts_of_sorted(s: Column) -> Column:
    """Map of each element to its number of occurrences in a sorted array: the distances between first places."""
    first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
    after = F.concat(F.slice(first, 2, F.greatest(F.size(first), F.lit(1))), F.array(F.size(s) + 1))
    counts = F.zip_with(first, after, lambda p, q: (q - p).cast("bigint"))
    some = F.map_from_arrays(F.transform(first, lambda i: F.element_at(s, i)), counts)
    return F.when(F.size(s) > 0, some).when(s.isNotNull(), F.map_from_arrays(s, F.array().cast("array<bigint>")))


def array_value_counts(a: Column) -> Column:
    """Map of each element to its number of occurrences, without nulls; {} for [], null for null. Without a shuffle.

    For long arrays use add_array_value_counts(), which sorts each array once.
    """
    return _counts_of_sorted(F.array_sort(F.filter(a, lambda x: x.isNotNull())))


def add_array_value_counts(df: DataFrame, terms: str, result: str = "{name}_counts") -> DataFrame:
    ordered = df.withColumn("__sorted", F.array_sort(F.filter(F.col(terms), lambda x: x.isNotNull())))
    return ordered.withColumn(result.format(name=terms), _counts_of_sorted(F.col("__sorted"))).drop("__sorted")


def add_tfidf(df: DataFrame, terms: str, result: str = "{name}_tfidf", normalize: bool = True, id: str | None = None) -> DataFrame:
    """df with a map of each term to its count times its idf, the counts over their length if `normalize`. {} for [], null for null.

    `id` names a unique column to join by; without it rows are numbered.
    """
    name, key = result.format(name=terms), id or "__row"
    base = df if id else df.withColumn("__row", F.monotonically_increasing_id())
    counted = add_array_value_counts(base.select(key, terms), terms, "__counts").select(key, "__counts")
    length = F.sqrt(F.aggregate(F.map_values("__counts"), F.lit(0.0), lambda s, x: s + x * x))
    each = counted.select(key, length.alias("__length"), F.explode("__counts").alias("term", "__n"))
    total = df.where(F.col(terms).isNotNull()).agg(F.count("*").alias("n_all"))
    idf = document_counts(df, terms).crossJoin(F.broadcast(total)).withColumn("idf", F.log(F.col("n_all") / F.col("n_records")))
    # terms in a hundredth of all records: at most a hundred times as many as a record has on average
    hot = idf.where((F.col("n_records") >= 10_000) & (F.col("n_records") * 100 >= F.col("n_all"))).select("term")
    scored = lookup(each, idf.select("term", "idf"), "term", hot=hot)
    weight = F.col("__n") * F.col("idf") / (F.col("__length") if normalize else F.lit(1.0))
    maps = scored.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", weight.alias("w"))))).alias("__map"))
    empty = F.map_from_arrays(F.slice(F.col(terms), 1, 0), F.array().cast("array<double>"))
    out = base.join(maps, key, "left").withColumn(name, F.coalesce("__map", F.when(F.col(terms).isNotNull(), empty))).drop("__map")
    return out if id else out.drop("__row")


def rare_terms(df: DataFrame, terms: str, max_records_n: int | None = None, max_records_frac: float | None = None) -> DataFrame:
    """Column term: the terms in at most so many records, or at most such a share of the records with an array."""
    if (max_records_n is None) == (max_records_frac is None):
        raise ValueError("give one of max_records_n and max_records_frac")
    counts = document_counts(df, terms)
    if max_records_n is not None:
        return counts.where(F.col("n_records") <= max_records_n).select("term")
    total = df.where(F.col(terms).isNotNull()).agg(F.count("*").alias("n_all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n_records") <= F.col("n_all") * max_records_frac).select("term")
