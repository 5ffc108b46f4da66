"""Passages of held-out test items that occur, wholly or in good part, in documents of a corpus."""

from __future__ import annotations

import html
import re
import unicodedata
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.groups import pairs_of_buckets
from kinweave.runtime import materialize, parallelism

#: Spaced seeds: positions of a window of tokens that must agree; the others may hold anything.
MASKS = ("111011", "110111", "1101011", "1110011", "10110101", "11000111")
#: Bits of the filter for each seed of the test items, and the most bits in all (128 MB), beyond which it lets more through.
FILTER, MOST = 16, 2**30
#: Passages under so many words are never found; those too short for the masks must occur word for word.
SHORTEST = 3
#: Around a hit, a position counts as covered if a run of WINDOW tokens that holds it agrees in at least AGREE.
WINDOW, AGREE = 8, 6
TAG = re.compile(r"<[^<>]{1,200}>")
WORD = re.compile(r"[^\W_]+")
#: Fixed value: an odd constant, the golden ratio in 64 bits, for mixing hashes.
MIX = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    """Letters and digits in lower case, without accents, markup and punctuation."""
    if not text:
        return []
    text = html.unescape(TAG.sub(" ", text)).casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return WORD.findall(text)


class _Hashes(dict):
    """64-bit hashes of tokens; forgets them when there are many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def hashed(tokens: list[str], cache: _Hashes) -> np.ndarray:
    return np.fromiter((cache[w] for w in tokens), np.uint64, len(tokens))


def seeds(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the window's kept positions, for each window that fits."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), (salt * MIX + 1) % 2**64, np.uint64)
    for j, kept in enumerate(mask):
        if kept == "1" and n > 0:
            out = (out ^ tokens[j : j + n]) * np.uint64(MIX)
            out ^= out >> np.uint64(29)
    return out


def masks_for(lengths: list[int]) -> list[tuple[int, str]]:
    """The masks and their salts, with whole words only for passages too short for any of MASKS."""
    least = min(map(len, MASKS))
    return list(enumerate(MASKS)) + [(len(MASKS) + n, "1" * n) for n in sorted(lengths) if SHORTEST <= n < least]


def passages(items: DataFrame, item: str, text: str) -> DataFrame:
    """Columns i, words and weights of each item's passage: without lines that several items share and without a question at the end.

    An item of which nothing would be left keeps its longest line; an item without words has no row. The weight of a word is its rarity among the items.
    """
    kind = items.schema[item].dataType.simpleString()

    def split(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                for k, line in enumerate((t or "").splitlines()):
                    w = words(line)
                    if w:
                        rows.append((i, k, w, line.rstrip().endswith("?"), xxhash.xxh3_64_intdigest(" ".join(w)) - 2**63))
            yield pd.DataFrame(rows, columns=["i", "at", "words", "asks", "line"])

    once = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull()).groupBy("i").agg(F.min("t").alias("t"))
    lines = materialize(once.mapInPandas(split, f"i {kind}, at int, words array<string>, asks boolean, line long"))
    shared = lines.groupBy("line").agg(F.countDistinct("i").alias("k"))
    own = lines.join(shared, "line").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "words", "asks", "k"))).alias("lines"))
    kept = F.filter("lines", lambda x: x["k"] == 1)
    asked = (F.size("kept") > 1) & F.element_at("kept", -1)["asks"]
    own = own.withColumn("kept", kept).withColumn("kept", F.when(asked, F.slice("kept", 1, F.size("kept") - 1)).otherwise(F.col("kept")))
    longest = F.array_max(F.transform("lines", lambda x: F.struct(F.size(x["words"]).alias("n"), (-x["at"]).alias("at"), x["words"].alias("words"))))["words"]
    own = own.select("i", F.when(F.size("kept") > 0, F.flatten(F.transform("kept", lambda x: x["words"]))).otherwise(longest).alias("words"))
    own = materialize(own.where(F.size("words") >= SHORTEST))
    each = own.select("i", F.posexplode("words").alias("at", "w"))
    rare = each.groupBy("w").agg(F.countDistinct("i").alias("k")).crossJoin(F.broadcast(own.agg(F.count("*").alias("n"))))
    rare = rare.select("w", F.log((1 + F.col("n")) / F.col("k")).alias("weight"))
    weights = each.join(rare, "w").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("ws"))
    return own.join(weights, "i").select("i", "words", F.transform("ws", lambda x: x["weight"]).alias("weights"))


class Filter:
    """A bitmap in which each seed of the items has two bits set."""

    def __init__(self, bits: int, bitmap: np.ndarray | None = None):
        self.bits = bits
        self.bitmap = np.zeros(bits // 8, np.uint8) if bitmap is None else bitmap

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(self.bits - 1)
        return keys & m, (keys >> np.uint64(32)) * np.uint64(MIX) >> np.uint64(17) & m

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bitmap, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b = (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in self.places(keys))
        return (a & b).astype(bool)


def covered(own: np.ndarray, weights: np.ndarray, tokens: np.ndarray, diagonals: list[int]) -> tuple[float, float]:
    """Of an item's tokens, the share that agrees in covered stretches on any diagonal: plain, and weighted by rarity among the items."""
    agree = np.zeros(len(own), bool)
    w = min(WINDOW, len(own))
    for d in diagonals:
        lo, hi = max(0, -d), min(len(own), len(tokens) - d)
        equal = own[lo:hi] == tokens[lo + d : hi + d]
        if len(equal) >= w:
            runs = np.convolve(equal, np.ones(w), "valid") >= AGREE * w / WINDOW
            agree[lo:hi] |= equal & (np.convolve(runs, np.ones(w)) > 0)
    return float(agree.mean()), float((agree * weights).sum() / max(weights.sum(), 1e-9))


def leaked(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.45, weighted: float = 0.4) -> DataFrame:
    """Documents that contain at least the share `share` of an item's passage: columns {item}, {id}, share and weighted.

    Case, accents, punctuation, markup and the order of sentences don't matter; words may be replaced, left out or added, and the passage may be
    interrupted. `weighted` is the least share when words count by their rarity among the items, so that phrases that all items share, filled
    with other facts, are no leak. Instruction and question lines are no part of a passage (see passages()). Null and empty
    texts contain nothing. Passages too short for the masks are found where they occur whole and unaltered, those under SHORTEST words never. Of an item
    delivered with several texts the least counts; a repeated row of either table counts once; empty tables give no rows.

    The corpus is read once. Its seeds pass a bitmap of the items' seeds, of a bounded size, and those that pass are joined with the items' seeds; what shares a
    seed is verified along the diagonals of its hits. Seeds that very many texts have are joined block by block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}, {f.name: f.dataType.simpleString() for f in items.schema}
    spark = documents.sparkSession

    def packed(batches):
        cache = _Hashes()
        for pdf in batches:
            tokens = [hashed(w, cache) for w in pdf["words"]]
            yield pd.DataFrame({"i": pdf["i"], "n": [len(t) for t in tokens], "own": [t.tobytes() for t in tokens], "weights": [np.asarray(w, np.float64).tobytes() for w in pdf["weights"]]})

    known = materialize(passages(items, item, item_text).mapInPandas(packed, f"i {kinds[1][item]}, n int, own binary, weights binary"))
    masks = masks_for([r["n"] for r in known.select("n").where(F.col("n") < min(map(len, MASKS))).distinct().collect()])

    def sow(batches):
        for pdf in batches:
            keys, owner, at = [np.zeros(0, np.uint64)], [], []
            for i, own in zip(pdf["i"], pdf["own"], strict=True):
                t = np.frombuffer(own, np.uint64)
                for salt, mask in masks:
                    if salt < len(MASKS) or len(mask) == len(t):
                        s = seeds(t, mask, salt)
                        keys.append(s)
                        owner += [i] * len(s)
                        at.append(np.arange(len(s), dtype=np.int32))
            yield pd.DataFrame({"i": pd.Series(owner, dtype=pdf["i"].dtype), "key": np.concatenate(keys).view(np.int64), "at": np.concatenate([*at, np.zeros(0, np.int32)])})

    sown = materialize(known.select("i", "own").mapInPandas(sow, f"i {kinds[1][item]}, key long, at int"))
    bits = min(MOST, max(2**20, 1 << (FILTER * sown.count()).bit_length()))

    def mark(batches):
        f = Filter(bits)
        for pdf in batches:
            f.add(pdf["key"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"bitmap": [f.bitmap.tobytes()]})

    parts = [np.frombuffer(r["bitmap"], np.uint8) for r in sown.select("key").coalesce(2).mapInPandas(mark, "bitmap binary").toLocalIterator()]
    passed = spark.sparkContext.broadcast(Filter(bits, np.bitwise_or.reduce(parts) if parts else None))

    def look(batches):
        cache = _Hashes()
        for pdf in batches:
            lists = [words(t) for t in pdf["t"]]
            n = np.array([len(x) for x in lists], np.int64)
            tokens = hashed([w for x in lists for w in x], cache)
            start = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(lists)), n)
            at, key = [], []
            for salt, mask in masks:
                s = seeds(tokens, mask, salt)
                inside = owner[: len(s)] == owner[len(mask) - 1 : len(mask) - 1 + len(s)]
                hit = np.flatnonzero(inside & passed.value.holds(s)) if len(s) else np.zeros(0, np.int64)
                at.append(hit)
                key.append(s[hit])
            at, key = np.concatenate(at), np.concatenate(key).view(np.int64)
            order = np.argsort(owner[at], kind="stable")
            at, key = at[order], key[order]
            docs, first = np.unique(owner[at], return_index=True)
            found = [(int(d), (at[a:b] - start[d]).astype(np.int32), key[a:b]) for d, a, b in zip(docs, first, np.append(first, len(at))[1:], strict=True)]
            keep = [d for d, _, _ in found]
            yield pd.DataFrame({"d": pdf["d"].iloc[keep].to_numpy(), "tokens": pd.Series([tokens[start[d] : start[d] + n[d]].tobytes() for d in keep], dtype=object), "at": pd.Series([x for _, x, _ in found], dtype=object), "key": pd.Series([x for _, _, x in found], dtype=object)})

    docs = documents.select(F.col(id).alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull() & (F.length("t") > 0))
    hit = materialize(docs.mapInPandas(look, f"d {kinds[0][id]}, tokens binary, at array<int>, key array<long>"))
    hit = hit.withColumn("row", F.xxhash64("d", "tokens"))
    each = hit.select("row", F.explode(F.arrays_zip("at", "key")).alias("x")).select("row", F.col("x.key").alias("key"), F.col("x.at").alias("pos"))
    met = pairs_of_buckets(each, sown, "key", "row", "i").select("row", "i", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    met = met.groupBy("row", "i").agg(F.collect_list("diagonal").alias("diagonals"))
    met = met.join(hit.select("row", "d", "tokens"), "row").join(known, "i")
    met = met.repartition(parallelism(spark), "row")

    def verify(batches):
        for pdf in batches:
            rows = []
            for i, d, t, own, ws, diagonals in pdf[["i", "d", "tokens", "own", "weights", "diagonals"]].itertuples(index=False, name=None):
                plain, heavy = covered(np.frombuffer(own, np.uint64), np.frombuffer(ws, np.float64), np.frombuffer(t, np.uint64), list(diagonals))
                if plain >= share and heavy >= weighted:
                    rows.append((i, d, plain, heavy))
            yield pd.DataFrame(rows, columns=["i", "d", "share", "weighted"])

    found = met.mapInPandas(verify, f"i {kinds[1][item]}, d {kinds[0][id]}, share double, weighted double")
    found = found.groupBy("i", "d").agg(F.max("share").alias("share"), F.max("weighted").alias("weighted"))
    return found.select(F.col("i").alias(item), F.col("d").alias(id), "share", "weighted")
