"""Texts that were cut off, at the length of a field or during transfer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.people import Words
from kinweave.runtime import materialize, spread

#: Bound of the sample that the classifier is fitted on: documents, taken by the hash of their id.
SAMPLE = 10_000
#: Words, endings and whole texts are usual from this share of all documents, and at least three, on.
USUAL = 3e-4
#: Examples of either kind made of one sampled document.
EXAMPLES = 6
BUCKETS = 2**18
#: Log odds from which a text counts as cut; above 0, as far fewer than half of the texts are cut.
THRESHOLD = 4.0
#: Marks that programs put where they cut.
MARKERS = ("…", "...", " [...]", "[…]", "... read more", "… more", " (...)", " (more)")
_MARKER = re.compile(r"(\s*(\[\s*(\.{3}|…)\s*\]|\(\s*(\.{3}|…|more)\s*\)|(\.{3}|…)\s*(read more|more|weiterlesen|leer más|lire la suite)|\.{2,}|…))+$", re.IGNORECASE)
_TAGS = re.compile(r"(\s*<[^<>]{0,80}>)+$")
_CLOSERS = "\"'”’»)]*_"
_END = re.compile(r"[.!?]+[\"'”’»)]*(?=\s)|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:['’.,/-][^\W_]+)*|[^\w\s]")


def _h(s: str) -> int:
    return zlib.crc32(s.encode()) % BUCKETS


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - 2**63


@dataclass
class Model:
    weights: np.ndarray
    words: Words

    def score(self, texts: list[str], limits: list[float]) -> np.ndarray:
        """Log odds of having been cut, for texts and their distances to a usual length of their source (NaN: none near)."""
        out = np.empty(len(texts))
        for k, (t, g) in enumerate(zip(texts, limits, strict=True)):
            out[k] = self.weights[features(t, g, self.words)].sum()
        return out


def features(text: str, to_limit: float, words: Container[str]) -> list[int]:
    """Buckets of what is at a text's end: marks, characters, the last words, whether the last word is known, and the nearness of a limit."""
    s = text.rstrip()
    s = _TAGS.sub("", s).rstrip()
    bare = _MARKER.sub("", s)
    marker = s[len(bare) :].strip().lower()
    body = bare.rstrip()
    core = body.rstrip(_CLOSERS).rstrip()
    stop = core[-1:] if core[-1:] in ".!?" else ""
    closed = body[len(core) :][:2]
    core = core.rstrip(".!?").rstrip()
    ends = list(_END.finditer(core[-400:]))
    last = core[-400:][ends[-1].end() :] if ends else core[-400:]
    tokens = [x.lower() for x in _TOKEN.findall(last)]
    before = [x.lower() for x in _TOKEN.findall(core[-120:])]
    w = (["^", "^", "^", *tokens])[-3:]
    word = w[-1]
    known = "-" if word == "^" or not word[0].isalpha() else str(int(word in words))
    near = "n" if not to_limit == to_limit else "0" if to_limit == 0 else "1"
    kind = marker if marker in ("", "…", "...") else "told"
    # what ends the text, and what the words before it say
    f = [
        "bias",
        f"stopped={bool(stop)}|{kind}",
        f"stopped={bool(stop)}|{near}|{kind}",
        f"stop={stop}|{kind}",
        f"closed={closed}",
        f"near={near}",
        f"near={near}|{stop}|{kind}",
        f"known={known}",
        f"known={known}|{stop}",
        f"w1={word}",
        f"w2={w[-2]} {word}",
        f"w3={w[-3]} {w[-2]} {word}",
        f"w1s={word}|{stop}",
        f"n={min(len(tokens), 12)}",
        f"n1={min(len(tokens), 12)}|{tokens[0] if tokens else ''}",
        f"n2={min(len(tokens), 14)}|{' '.join(tokens[:3])}",
        f"b2={' '.join(before[-2:])}",
        f"c1={core[-1:].lower()}",
        f"c2={core[-2:].lower()}",
        f"c3={core[-3:].lower()}",
        f"case={last[:1].isupper()}",
    ]
    return [_h(x) for x in f]


def _end(text: str) -> tuple[str, str, bool]:
    """The last two words, the last one alone, and whether something else than a letter or digit follows them."""
    bare = _MARKER.sub("", _TAGS.sub("", text.rstrip()).rstrip()).rstrip()
    w = [x.lower() for x in _TOKEN.findall(bare[-80:]) if x[0].isalnum()][-2:]
    return " ".join(w), w[-1] if w else "", not bare[-1:].isalnum()


def _examples(t: str, to_limit: float, limits: list[int], usual: bool, rng: np.random.Generator) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """Cut and intact examples made of a text. Cuts lie anywhere but at the end of a sentence; some lie at a limit, some bear a marker.

    A whole text is taken as intact if a mark ends it or if it, or its ending, is usual.
    """
    cut, intact = [], []
    nan = float("nan")
    if to_limit == 0:
        return cut, intact  # as long as its source's field: its end may be a real cut
    if _end(t)[2] or usual:
        intact += [(t, 0.0 if rng.random() < 0.05 else to_limit)] * 2
    ends = [m.end() for m in _END.finditer(t)]
    at = set(ends)
    for _ in range(EXAMPLES):
        if ends:
            e = int(rng.choice(ends))
            s = t[:e].rstrip()
            r = rng.random()
            s = s.rstrip(".!?") if r < 0.35 else s.rstrip(".!?") + ("…" if rng.random() < 0.5 else "...") if r < 0.5 else s
            intact.append((s, 0.0 if rng.random() < 0.1 else nan))
        if len(t) > 25:
            fits = [x for x in limits if x < len(t) - 1]
            e = int(rng.choice(fits)) if fits and rng.random() < 0.3 else int(rng.integers(20, len(t) - 1))
            if any(x in at for x in (e, e + 1)) or t[e - 1] in ".!?\n" or t[e:].lstrip()[:1] in ("", ".", "!", "?") or t[e:].strip(" .!?\n\"'”’»)]*_…") == "":
                continue
            r = rng.random()
            cut.append((t[:e] + (str(rng.choice(MARKERS)) if r < 0.25 else ""), 0.0 if rng.random() < 0.6 else nan))
    return cut, intact


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, passes: int = 8, rate: float = 0.25, shrink: float = 2e-6) -> np.ndarray:
    """Weights by bucket: logistic regression on hashed features, by adaptive gradient steps over small batches. Both classes weigh the same."""
    out = np.zeros(BUCKETS)
    if not 0 < y.sum() < len(y):
        return out
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(len(y), -1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 512):
            k = order[lo : lo + 512]
            p = 1 / (1 + np.exp(-np.clip(w[x[k]].sum(axis=1), -30, 30)))
            g = np.bincount(x[k].ravel(), weights=np.repeat((p - y[k]) * weight[k], x.shape[1]))
            at = np.flatnonzero(g)
            step = g[at] / len(k) + shrink * w[at]
            squares[at] += step**2
            w[at] -= rate * step / np.sqrt(squares[at])
    out[used] = w
    return out


def usual_lengths(documents: DataFrame, text: str = "text", source: str = "source", least: int = 5, times: float = 6.0) -> DataFrame:
    """Columns source, size and n: lengths at which a source has unusually many texts, as the length of a field gives them.

    Unusual: at least `least` texts, 0.2 percent of the source's and `times` the mean number a length among lengths up to a tenth shorter.
    """
    from pyspark.sql import Window

    sized = documents.where(F.length(text) >= 40).select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.length(text).alias("size"))
    by = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    share = by.withColumn("all_n", F.sum("n").over(Window.partitionBy("source")))
    near = Window.partitionBy("source").orderBy(F.floor(F.log("size") * 1000).cast("long")).rangeBetween(-100, -1)
    share = share.withColumn("around", F.coalesce(F.sum("n").over(near), F.lit(0)) / F.greatest(F.col("size") * 0.1, F.lit(1.0)))
    return share.where((F.col("n") >= least) & (F.col("n") >= F.col("all_n") * 0.002) & (F.col("n") >= F.col("around") * times)).select("source", "size", "n")


def cut_scores(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", also: str | None = None, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """Columns {id}, source and score, the log odds that the text was cut off (null for null and blank texts), a row for each row.

    Intact values are cut artificially to get positives; a logistic regression on hashed features of the end of the text is fitted on a
    bounded sample of documents (at most `sample`, by the hash of the id, of any length) and scores all of them. What words, endings and whole texts are usual is
    counted over all documents. Examples and their features are made in the tasks, so that the driver holds no text. `also` names a column of short
    values, as titles, whose sampled values are examples of intact text too. Usual lengths are counted over all. Rows with a null id are left out; a null source is one source of its own; without any document there is no row.
    """
    limits = materialize(usual_lengths(documents, text, source))
    more = F.col(also).cast("string") if also else F.lit(None).cast("string")
    docs = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), more.alias("also"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).where(F.col("id").isNotNull())
    kind = docs.schema["id"].dataType.simpleString()
    least = F.greatest(F.lit(3.0), F.col("n_all") * USUAL)

    def count(batches):
        for pdf in batches:
            n: Counter = Counter()
            for t in pdf["text"].dropna():
                if t.strip():
                    n["n", 0] += 1
                    n["t", _key(t)] += 1
                    n["e", _key(_end(t)[0])] += 1
                    for x in _TOKEN.findall(t)[:-1]:  # the last may be the part of a word
                        n["w", x.lower()] += 1
            yield pd.DataFrame([(k, w if k == "w" else None, 0 if k == "w" else h, c) for (k, h), c in n.items() for w in (h,)], columns=["kind", "word", "key", "n"])

    counted = docs.select("text").mapInPandas(count, "kind string, word string, key long, n long").groupBy("kind", "word", "key").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    total = counted.where("kind = 'n'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    counted = materialize(counted.where("kind <> 'n'").crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("kind", "word", "key"))
    words = documents.sparkSession.sparkContext.broadcast(Words.of(counted.where("kind = 'w'"), "word"))

    marked = docs.withColumn("size", F.length("text")).join(limits.select("source", "size", F.lit(0.0).alias("to_limit")), ["source", "size"], "left").drop("size")
    taken = docs.where(F.length(F.btrim("text")) > 0).select("id", "source").orderBy(F.xxhash64("id"), "id").limit(sample)
    taken = marked.join(materialize(taken).select("id").distinct(), "id", "left_semi").where(F.length(F.btrim("text")) > 0)

    def ends(batches):
        for pdf in batches:
            yield pdf.assign(whole=pdf["text"].map(_key), ending=pdf["text"].map(lambda t: _key(_end(t)[0])), word=pdf["text"].map(lambda t: _end(t)[1]))

    taken = taken.mapInPandas(ends, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in taken.schema)}, whole long, ending long, word string")
    usual = lambda k, name: counted.where(F.col("kind") == k).select(F.col("key").alias(name), F.lit(True).alias(f"{name}_usual"))
    taken = taken.join(usual("t", "whole"), "whole", "left").join(usual("e", "ending"), "ending", "left")
    taken = materialize(taken.join(limits.groupBy("source").agg(F.sort_array(F.collect_list("size")).alias("limits")), "source", "left"))  # at most 500 a source

    def learn(batches):
        for pdf in batches:
            rows = []
            for t, g, whole, ending, word, near, i in pdf[["text", "to_limit", "whole_usual", "ending_usual", "word", "limits", "id"]].astype(object).itertuples(index=False, name=None):
                told = ending is True and (word in words.value or not word[:1].isalpha())
                cut, intact = _examples(t, 0.0 if g == 0 else float("nan"), [] if near is None else list(near), whole is True or told, np.random.default_rng(abs(_key(f"{seed}:{i}"))))
                rows += [(features(x, d, words.value), y) for xs, y in ((cut, 1.0), (intact, 0.0)) for x, d in xs]
            yield pd.DataFrame(rows, columns=["x", "y"])

    def learn_also(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, float("nan"), words.value) for t, n in zip(pdf["also"], pdf["n"], strict=True) for _ in range(n)], "y": 0.0})

    titles = taken.where(F.length("also").between(1, 60)).groupBy("also").agg(F.least(F.count("*"), F.lit(20)).alias("n")).where("n >= 2")
    schema = "x array<int>, y double"
    rows = spread(taken).mapInPandas(learn, schema).unionByName(titles.mapInPandas(learn_also, schema)).toPandas()
    rows = rows.assign(key=[hash(tuple(x)) for x in rows["x"]]).sort_values(["y", "key"], kind="stable")  # in whatever order tasks end
    fitted = fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(), seed) if len(rows) else np.zeros(BUCKETS)
    model = documents.sparkSession.sparkContext.broadcast(Model(fitted, words.value))

    def score(batches):
        for pdf in batches:
            known = pdf["text"].map(lambda t: t is not None and bool(t.strip())).to_numpy(dtype=bool)
            out = np.full(len(pdf), np.nan)
            out[known] = model.value.score(pdf["text"][known].tolist(), pdf["to_limit"][known].astype(float).tolist())
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "score": pd.Series(out).astype(object).where(known, None)})

    scored = marked.select("id", "text", "source", "to_limit").mapInPandas(score, f"id {kind}, source string, score double")
    return scored.withColumnRenamed("id", id)


def cut_off(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = THRESHOLD, **more) -> DataFrame:
    """Column {id}: the documents whose score lies above the threshold, once each. See cut_scores()."""
    return cut_scores(documents, id, text, source, **more).where(F.col("score") > threshold).select(id).distinct()


def cut_rates(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = THRESHOLD, **more) -> DataFrame:
    """Columns source, n_documents, n_cut and share: how often each source cuts. Null and blank texts count as documents that aren't cut."""
    scored = cut_scores(documents, id, text, source, **more)
    cut = F.count(F.when(F.col("score") > threshold, 1))
    out = scored.groupBy("source").agg(F.count("*").alias("n_documents"), cut.alias("n_cut"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_documents"))
