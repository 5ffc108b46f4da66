"""Linkers: which pairs of records to look at. A linker is called with a left and a right table of records and gives a Linkage.

The task is "dedupe" (pairs of different records of one table, smaller id left) or "link" (all pairs of two tables). It is taken from the
tables, if they are the same one or not, unless it is named.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.joins import _Suffixed, condition, or_join
from kinweave.operators.model import Linkage
from kinweave.operators.resolve import name_of, pairs, resolve
from kinweave.plans.joins import check_join_algorithm

IDS = ("record_id_l", "record_id_r")
#: Rules of an OrLinker whose sets are counted one by one at most.
MAX_COUNTED = 5


def infer_task(left: DataFrame, right: DataFrame, task: str | None = None) -> str:
    if task not in (None, "dedupe", "link"):
        raise ValueError(f"task is 'dedupe' or 'link', not {task!r}")
    return task or ("dedupe" if left is right or left.sameSemantics(right) else "link")


def _id(df: DataFrame, side: str) -> Column:
    return F.col("record_id").alias(f"record_id_{side}")


@dataclass(frozen=True)
class FullLinker:
    """All pairs. Only for tables of which the product is small."""

    task: str | None = None

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        links = left.select(_id(left, "l")).crossJoin(right.select(_id(right, "r")))
        if infer_task(left, right, self.task) == "dedupe":
            links = links.where("record_id_l < record_id_r")
        return Linkage(left, right, links)


@dataclass(frozen=True)
class EmptyLinker:
    """No pair."""

    task: str | None = None

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        return Linkage(left, right, left.select(_id(left, "l")).join(right.select(_id(right, "r")), F.lit(False)))


@dataclass(frozen=True)
class JoinLinker:
    """Pairs that meet a join condition; a join that compares all with all raises, warns or passes.

    `near` names a number that both tables have and how far apart it is at most under the condition `on`, which is still checked: rows then meet those of
    their bin of that width and of the two beside it only.
    """

    on: Any
    task: str | None = None
    on_slow: str = "error"
    near: tuple[str, float] | None = None

    def _binned(self, left: DataFrame, right: DataFrame) -> Linkage:
        name, most = self.near
        if not 0 < most < math.inf:
            raise ValueError(f"near needs a distance above 0, not {most!r}")
        # a little wider than the distance, so that rounding can't part two bins; what is too large for that shares the last one
        x = F.col(name).cast("double") / F.lit(most * (1 + 1e-3))
        place = F.floor(F.least(F.greatest(x, F.lit(-(2.0**40))), F.lit(2.0**40)))
        a = left.where(F.col(name).isNotNull()).withColumn("__bin", place)
        b = right.where(F.col(name).isNotNull()).withColumn("__bin", F.explode(F.array(place - 1, place, place + 1)))
        dedupe = ("record_id", "record_id") if infer_task(left, right, self.task) == "dedupe" else None
        on = ["__bin", *(self.on if isinstance(self.on, list) else [self.on])]
        return Linkage(left, right, or_join(a, b, {"on": on}, dedupe, self.on_slow).select(*IDS))

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        if self.near:
            return self._binned(left, right)
        dedupe = ("record_id", "record_id") if infer_task(left, right, self.task) == "dedupe" else None
        return Linkage(left, right, or_join(left, right, {"on": self.on}, dedupe, self.on_slow).select(*IDS))


@dataclass(frozen=True)
class KeyLinker:
    """Pairs that agree in all keys, none of them null.

    A key is a name, column or function, or a 2-tuple of them for the left and the right table. With `max_pairs`, records whose key would give more
    left times right pairs are left out; their keys are counted, not joined.
    """

    keys: Any
    max_pairs: int | None = None
    task: str | None = None

    def _keyed(self, df: DataFrame, side: int, ids: bool = True) -> DataFrame:
        made = [resolve(df, p[side]).alias(n) for p, n in zip(pairs(self.keys), self.names, strict=True)]
        out = df.select(*([F.col("record_id")] if ids else []), *made)
        return out.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in self.names]))

    @property
    def names(self) -> list[str]:
        return [name_of(p[0], i) for i, p in enumerate(pairs(self.keys))]

    def key_counts_left(self, left: DataFrame) -> DataFrame:
        """The keys and n, the number of left records with them, most frequent first."""
        return self._keyed(left, 0, False).groupBy(*self.names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *self.names)

    def key_counts_right(self, right: DataFrame) -> DataFrame:
        return self._keyed(right, 1, False).groupBy(*self.names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *self.names)

    def _both_counts(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a = self._keyed(left, 0, False).groupBy(*self.names).agg(F.count("*").alias("n_l"))
        b = self._keyed(right, 1, False).groupBy(*self.names).agg(F.count("*").alias("n_r"))
        return a.join(b, self.names)

    def pair_counts(self, left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
        """The keys and n, the number of pairs they give, without joining records; most pairs first, or unordered, which saves a shuffle."""
        task = infer_task(left, right, self.task)
        if task == "dedupe" and all(p[0] is p[1] or p[0] == p[1] for p in pairs(self.keys) if isinstance(p[0], str)):
            counts = self._keyed(left, 0, False).groupBy(*self.names).agg(F.count("*").alias("n_l"))
            n = F.expr("n_l * (n_l - 1) div 2")
        else:
            counts = self._both_counts(left, right)
            n = F.expr("n_l * (n_l - 1) div 2") if task == "dedupe" else F.expr("n_l * n_r")
        out = counts.select(*self.names, n.cast("long").alias("n"))
        if self.max_pairs is not None:
            out = out.where(F.col("n") <= self.max_pairs)
        return out.orderBy(F.desc("n"), *self.names) if ordered else out

    def too_common(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The keys of which left times right records are over max_pairs."""
        return self._both_counts(left, right).where(F.col("n_l") * F.col("n_r") > self.max_pairs).select(*self.names)

    def _members(self, df: DataFrame) -> DataFrame:
        if self.max_pairs is not None or any(not (a is b or (isinstance(a, str) and a == b)) for a, b in pairs(self.keys)):
            raise ValueError("only for the same keys on both sides, without max_pairs")
        return self._keyed(df, 0).where(F.col("record_id").isNotNull()).distinct()

    def degrees(self, df: DataFrame) -> DataFrame:
        """Columns record_id and degree: how many different records each linked record of one table would be linked with, from counts of keys.

        Pairs are made for ids alone that come with several keys, as these may meet one record under each.
        """
        members = self._members(df)
        counted = members.join(members.groupBy(*self.names).agg(F.count("*").alias("n")), self.names)
        each = counted.groupBy("record_id").agg(F.count("*").alias("n_keys"), (F.max("n") - 1).alias("degree"))
        several = each.where("n_keys > 1").select("record_id")
        met = members.join(several, "record_id", "left_semi").join(members.withColumnRenamed("record_id", "other"), self.names).where("record_id <> other")
        out = each.where("n_keys = 1").select("record_id", "degree").unionByName(met.groupBy("record_id").agg(F.countDistinct("other").alias("degree")))
        return out.where("degree > 0")

    def spanning_links(self, df: DataFrame) -> DataFrame:
        """Columns record_id_l and record_id_r: each record with the least one of its keys. They join the same records, directly or through others, as all links of one table do."""
        members = self._members(df)
        least = members.groupBy(*self.names).agg(F.min("record_id").alias("record_id_l"))
        return members.withColumnRenamed("record_id", "record_id_r").join(least, self.names).where("record_id_l < record_id_r").select(*IDS)

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        a, b = self._keyed(left, 0), self._keyed(right, 1)
        if self.max_pairs is not None:
            many = self.too_common(left, right)
            a, b = a.join(many, self.names, "left_anti"), b.join(many, self.names, "left_anti")
        links = a.withColumnRenamed("record_id", "record_id_l").join(b.withColumnRenamed("record_id", "record_id_r"), self.names)
        if infer_task(left, right, self.task) == "dedupe":
            links = links.where("record_id_l < record_id_r")
        return Linkage(left, right, links.select(*IDS))


@dataclass(frozen=True)
class OrLinker:
    """Pairs that meet any of several conditions, each once, as a union of joins on equal keys."""

    conditions: Mapping[str, Any] | Iterable[Any] = field(default_factory=dict)
    task: str | None = None
    on_slow: str = "error"

    def _named(self) -> dict[str, Any]:
        if isinstance(self.conditions, Mapping):
            return dict(self.conditions)
        return {name_of(c, i) if isinstance(c, str) else f"rule_{i}": c for i, c in enumerate(self.conditions)}

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        named = self._named()
        if not named:
            return EmptyLinker()(left, right)
        dedupe = ("record_id", "record_id") if infer_task(left, right, self.task) == "dedupe" else None
        return Linkage(left, right, or_join(left, right, named, dedupe, self.on_slow).select(*IDS))

    def _names(self) -> dict[str, list[str]] | None:
        """The column names that each rule wants equal, if no rule wants anything else."""
        named = {n: [c] if isinstance(c, str) else c for n, c in self._named().items()}
        return named if all(isinstance(c, list) and c and all(isinstance(x, str) for x in c) for c in named.values()) else None

    def _same_names(self, left: DataFrame, right: DataFrame) -> bool:
        """Pairs can be counted from counts of keys: one table, rules of names, few enough for each set of them, and ids that don't repeat."""
        named = self._names()
        if not named or len(named) > MAX_COUNTED or not (left is right or left.sameSemantics(right)):
            return False
        return left.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def _counted(self, df: DataFrame) -> DataFrame:
        """rule_counts() of one table: the pairs that meet at least a set of rules agree in all their names, and those of larger sets are taken off."""
        named = self._names()
        sets = [s for k in range(1, len(named) + 1) for s in combinations(sorted(named), k)]
        least = None
        for i, s in enumerate(sets):
            names = sorted({c for r in s for c in named[r]})
            known = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names], F.col("record_id").isNotNull()))
            n = known.groupBy(*names).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("least"))
            n = n.select(F.lit(i).alias("of"), "least")
            least = n if least is None else least.unionByName(n)
        signs = [(i, j, (-1) ** (len(t) - len(s))) for i, s in enumerate(sets) for j, t in enumerate(sets) if set(s) <= set(t)]
        signed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("sign")) for i, j, v in signs])).alias("x")
        rules = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in sets]), F.col("x.i") + 1)
        exact = least.select("of", "least", signed).where("of = x.j").groupBy("x.i").agg(F.sum(F.col("least") * F.col("x.sign")).alias("n"), F.first("x").alias("x"))
        return exact.where("n > 0").select(rules.alias("rules"), F.col("n").cast("long").alias("n"))

    def rule_counts(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Columns rules (sorted names) and n: the pairs that meet just these rules. Counted from keys where _same_names() holds, else by one pass over the pairs of each rule."""
        dedupe = infer_task(left, right, self.task) == "dedupe"
        if dedupe and self._same_names(left, right):
            return self._counted(left)
        a, b = left.toDF(*[f"{c}_l" for c in left.columns]), right.toDF(*[f"{c}_r" for c in right.columns])
        out = None
        for name, spec in self._named().items():
            part = a.join(b, condition(spec, _Suffixed(a, "_l"), _Suffixed(b, "_r")))
            check_join_algorithm(part, self.on_slow)
            part = (part.where("record_id_l < record_id_r") if dedupe else part).select(*IDS, F.lit(name).alias("rule"))
            out = part if out is None else out.unionByName(part)
        each = out.groupBy(*IDS).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
        return each.groupBy("rules").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class UnnestLinker:
    """Pairs whose arrays share an element, each once. Null elements don't count."""

    column: Any
    task: str | None = None

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        keys = pairs([self.column])[0]

        def each(df: DataFrame, key: Any, side: str) -> DataFrame:
            x = df.select(_id(df, side), F.explode(F.array_distinct(resolve(df, key))).alias("element"))
            return x.where(F.col("element").isNotNull())

        links = each(left, keys[0], "l").join(each(right, keys[1], "r"), "element")
        if infer_task(left, right, self.task) == "dedupe":
            links = links.where("record_id_l < record_id_r")
        return Linkage(left, right, links.select(*IDS).distinct())


@dataclass(frozen=True)
class IDLinker:
    """Links by labels that say which records match.

    when_null and when_not_equal say what a null label, and labels that differ, mean: "match", "nonmatch" or "indefinite". Pairs of the
    two tables come in both directions and with themselves, as the tables give them.
    """

    label: Any
    when_null: str = "indefinite"
    when_not_equal: str = "nonmatch"

    def __post_init__(self) -> None:
        for v in (self.when_null, self.when_not_equal):
            if v not in ("match", "nonmatch", "indefinite"):
                raise ValueError(f"{v!r} isn't 'match', 'nonmatch' or 'indefinite'")

    def _sides(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        k = pairs([self.label])[0]
        return left.select(_id(left, "l"), resolve(left, k[0]).alias("label_l")), right.select(_id(right, "r"), resolve(right, k[1]).alias("label_r"))

    def match_linkage(self, left: DataFrame, right: DataFrame) -> Linkage:
        a, b = self._sides(left, right)
        return Linkage(left, right, a.join(b, F.col("label_l") == F.col("label_r")).select(*IDS))

    def linkage(self, left: DataFrame, right: DataFrame, verdict: str) -> Linkage:
        """The pairs of a verdict. But for matches by equal labels, these are nearly all pairs: for small tables."""
        if verdict == "match" and "match" not in (self.when_null, self.when_not_equal):
            return self.match_linkage(left, right)
        a, b = self._sides(left, right)
        said = F.when(F.col("label_l").isNull() | F.col("label_r").isNull(), self.when_null).when(F.col("label_l") == F.col("label_r"), "match").otherwise(self.when_not_equal)
        return Linkage(left, right, a.crossJoin(b).where(said == verdict).select(*IDS))

    def nonmatch_linkage(self, left: DataFrame, right: DataFrame) -> Linkage:
        return self.linkage(left, right, "nonmatch")

    def indefinite_linkage(self, left: DataFrame, right: DataFrame) -> Linkage:
        return self.linkage(left, right, "indefinite")


def p_blocked(jaccard: Column | float, band_size: int, n_bands: int) -> Column | float:
    """Chance that two sets of a Jaccard similarity share a band: 1 - (1 - J^size)^bands."""
    if isinstance(jaccard, Column):
        return 1 - F.pow(1 - F.pow(jaccard, band_size), n_bands)
    return 1 - (1 - jaccard**band_size) ** n_bands


#: Band sizes and numbers of bands of the curves.
LSH_GRID = ((2, 5), (2, 10), (2, 20), (2, 40), (5, 5), (5, 10), (5, 20), (5, 40), (10, 5), (10, 10), (10, 20), (10, 40), (10, 80))


def lsh_curves(spark: Any, grid: Iterable[tuple[int, int]] = LSH_GRID, points: int = 51) -> DataFrame:
    """Columns band_size, n_bands, jaccard and p: the chance of sharing a band over a grid of parameters."""
    base = spark.createDataFrame(list(grid), "band_size int, n_bands int")
    j = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("jaccard", F.col("k") / F.lit(float(points - 1)))
    return j.select("band_size", "n_bands", "jaccard", (1 - F.pow(1 - F.pow("jaccard", F.col("band_size")), F.col("n_bands"))).alias("p"))


@lru_cache(maxsize=8)
def _hash_functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Least value of each of n multiply-and-shift functions over the hashes, in chunks of them."""
    a, b = _hash_functions(n, seed)
    out = np.full(n, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), 8192):
        x = hashes[lo : lo + 8192, None].astype(np.uint64) * a[None, :] + b[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0), out=out)
    return out


def minhash_keys(terms: Column, band_size: int, n_bands: int, seed: int = 42) -> Column:
    """One key a band: the band's minima over the terms of `band_size` hash functions, hashed. Null for null and empty arrays.

    Terms are hashed once, in the JVM; the minima of each row's hashes are taken by numpy, an Arrow batch at a time.
    """
    weights, _ = _hash_functions(band_size, seed + 1)
    salts = np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(h: pd.Series) -> pd.Series:
        out = []
        for x in h:
            if x is None or len(x) == 0:
                out.append(None)
                continue
            s = signature(np.asarray(x, np.int64).view(np.uint64), band_size * n_bands, seed).reshape(n_bands, band_size)
            out.append(((s * weights).sum(axis=1, dtype=np.uint64) ^ salts).view(np.int64))
        return pd.Series(out, dtype=object)

    return keys(F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.xxhash64(t, F.lit(seed))))


@dataclass(frozen=True)
class MinhashLshLinker:
    """Pairs whose sets of terms share a band of MinHash values, each once."""

    terms: Any
    band_size: int = 5
    n_bands: int = 10
    task: str | None = None
    seed: int = 42

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        key = lambda df: minhash_keys(resolve(df, self.terms), self.band_size, self.n_bands, self.seed)
        linkage = UnnestLinker(key, infer_task(left, right, self.task))(left, right)
        return linkage


def coordinate_bins(lat: Column, lon: Column, distance_km: float) -> tuple[Column, Column]:
    """Row and column of a grid of three times the distance; null if either coordinate is."""
    step = 3 * distance_km
    per_degree = math.pi * 6371.0 / 180
    known = lat.isNotNull() & lon.isNotNull()
    row = F.floor(lat / F.lit(step / per_degree))
    column = F.floor(lon / (F.lit(step) / (F.lit(per_degree) * F.cos(F.radians(lat)))))
    return F.when(known, row.cast("long")), F.when(known, column.cast("long"))


@dataclass(frozen=True)
class CoordinateLinker:
    """Pairs in the same bin of a grid of three times the distance.

    Fast and approximate: near a bin's edge, close pairs are lost and others up to three times as far are found. `exact=True` gives just
    the pairs within the distance (operators.spatial.pairs_within).
    """

    distance_km: float
    lat: Any = "lat"
    lon: Any = "lon"
    max_pairs: int | None = None
    exact: bool = False
    task: str | None = None

    def key_linker(self, task: str | None = None) -> KeyLinker:
        bins = lambda df: coordinate_bins(resolve(df, self.lat), resolve(df, self.lon), self.distance_km)
        return KeyLinker([(lambda df: bins(df)[0]), (lambda df: bins(df)[1])], self.max_pairs, task or self.task)

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        if not self.exact:
            return self.key_linker()(left, right)
        from kinweave.operators.spatial import pairs_within

        at = lambda df: df.select("record_id", resolve(df, self.lat).alias("lat"), resolve(df, self.lon).alias("lon"))
        other = None if infer_task(left, right, self.task) == "dedupe" else at(right)
        return Linkage(left, right, pairs_within(at(left), other, self.distance_km).select(*IDS))


@dataclass(frozen=True)
class NameBlocker:
    """Pairs of which any part of one name equals any part of the other: normalized parts are unnested once and joined."""

    name: str = "name"
    parts: tuple[str, ...] = ("prefix", "given", "middle", "surname", "suffix", "nickname")
    task: str | None = None

    def __call__(self, left: DataFrame, right: DataFrame) -> Linkage:
        from kinweave.functions.names import normalize_name_field

        def words(df: DataFrame) -> Column:
            return F.filter(F.array(*[normalize_name_field(df[self.name][p]) for p in self.parts]), lambda w: w.isNotNull() & (w != ""))

        return UnnestLinker(words, infer_task(left, right, self.task))(left, right)


def linker_of(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], Linkage]:
    """A linker from a function that gives a table of links."""
    return lambda left, right: Linkage(left, right, f(left, right))
