"""Items of varying length in containers of fixed capacity, with little unused space."""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import materialize

#: Folder of the tokenizers' files on each machine.
TOKENIZERS = "/opt/tokenizers"
#: Pieces that one task packs together.
SHARD = 50_000
#: Containers filled less than this are emptied and packed again together with those of other tasks.
FULL = 0.98
#: Words from which equal texts count as copies of each other.
COPY_WORDS = 5


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(documents: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns {id}, size (tokens of the whole text; 0 for null and empty texts) and those in `keep`, a row for each row with an id."""
    path = str(Path(folder) / tokenizer)
    docs = documents.select(F.col(id).alias("id"), *keep, F.coalesce(text, F.lit("")).alias("text")).where(F.col("id").isNotNull())
    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in ("id", *keep))

    def count(batches):
        t = _tokenizer(path)
        for pdf in batches:
            size = []
            for lo in range(0, len(pdf), 256):
                size += [len(e.ids) for e in t.encode_batch(pdf["text"].iloc[lo : lo + 256].tolist(), add_special_tokens=False)]
            yield pdf.drop(columns="text").assign(size=size)

    return docs.mapInPandas(count, f"{schema}, size long").withColumnRenamed("id", id)


def copies(text: str | Column) -> Column:
    """A key that texts share if they differ in case, punctuation and white space only; null for texts of under five words."""
    words = F.btrim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.size(F.split(words, " ")) >= COPY_WORDS, F.sha2(words, 256))


class Bins:
    """Open containers ordered by residual capacity; each carries bitmaps of the sources and duplicate clusters in it.

    For every conflict that an item can have, the containers that bear its bit are known by residual, so that a search skips whole residuals
    whose containers all conflict.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.members: list[list[int]] = []
        self.at: dict[int, dict[int, None]] = {}
        self.bearing: dict[tuple[str, int], dict[int, int]] = {}  # of a conflict's bit: how many containers of each residual bear it
        self.present = 0  # bit r is set if a container has the residual r

    def _bits(self, b: int) -> list[tuple[str, int]]:
        out = []
        for kind, bits in (("c", self.clusters[b]), ("s", self.sources[b])):
            while bits:
                low = bits & -bits
                out.append((kind, low))
                bits ^= low
        return out

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            del self.at[old][b]
            if not self.at[old]:
                self.present &= ~(1 << old)
            for k in self._bits(b):
                self.bearing[k][old] -= 1
        self.residual[b] = new
        self.at.setdefault(new, {})[b] = None
        self.present |= 1 << new

    def _free(self, r: int, cluster: int, source: int) -> int:
        """The first container of residual r without the item's bits, -1 if there is none."""
        n = len(self.at[r])
        if any(bit and self.bearing.get((kind, bit), {}).get(r, 0) == n for kind, bit in (("c", cluster), ("s", source))):
            return -1
        return next((b for b in self.at[r] if not (self.clusters[b] & cluster or self.sources[b] & source)), -1)

    def put(self, item: int, size: int, cluster: int = 0, source: int = 0) -> int:
        """Into the tightest container that fits and has none of the item's bits, or a new one; its number. Bits are 0 for no conflict."""
        r = size
        while True:
            rest = self.present >> r
            if not rest:
                b = len(self.residual)
                self.residual.append(self.capacity)
                self.clusters.append(0)
                self.sources.append(0)
                self.members.append([])
                self._move(b, None, self.capacity - size)
                break
            r += (rest & -rest).bit_length() - 1
            b = self._free(r, cluster, source)
            if b >= 0:
                self._move(b, r, r - size)
                break
            r += 1
        self.clusters[b] |= cluster
        self.sources[b] |= source
        for k in self._bits(b):
            self.bearing.setdefault(k, {})
            self.bearing[k][self.residual[b]] = self.bearing[k].get(self.residual[b], 0) + 1
        self.members[b].append(item)
        return b


def best_fit(sizes: list[int], capacity: int, clusters: list[object] | None = None, sources: list[object] | None = None, per_source: int = 1) -> list[int]:
    """The container number of each item, by decreasing size (best fit). No size exceeds the capacity.

    Items of one cluster (None: none) get different containers as far as there are enough: of a cluster with more items than the total size needs
    containers, every so many share a bit. With `sources`, no two items of a source share a container, unless `per_source` says how many at most may: then items
    of a source take that many bits in turn.
    """
    need = max(1, -(-sum(sizes) // capacity))
    number = Counter(c for c in clusters or [] if c is not None)
    share = Counter(sources or [])
    seen: Counter = Counter()
    bit: dict[object, int] = {}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], -(number[clusters[i]] if clusters else 0), i))
    bins, out = Bins(capacity), [0] * len(sizes)
    for i in order:
        c = s = 0
        if clusters and number[clusters[i]] > 1 and clusters[i] is not None:
            key = (clusters[i], seen[clusters[i]] // need)
            seen[clusters[i]] += 1
            c = 1 << bit.setdefault(("c", *key), len(bit))
        if sources is not None:
            turn = seen["s", sources[i]] % per_source
            seen["s", sources[i]] += 1
            s = 1 << bit.setdefault(("s", sources[i], turn), len(bit)) if share[sources[i]] > 1 else 0
        out[i] = bins.put(i, sizes[i], c, s)
    return out


def pack(items: DataFrame, containers: DataFrame, id: str = "doc_id", size: str = "size", cluster: str | None = None, source: str | None = None, kind: str = "container_kind", capacity: str = "capacity_tokens", shard: int = SHARD, per_source: int = 1) -> DataFrame:
    """Columns {kind}, container_id, position, {id}, piece and size: all items packed into containers of each kind.

    An item over the capacity is split into pieces of just the capacity and a rest, other items are whole (piece 0). Positions count from 0 in
    each container. `cluster` names a column of duplicate clusters: copies are kept apart (see best_fit()); nulls belong to none. With
    `source`, at most `per_source` pieces of a source share a container (a null source is one too). Items of size 0 or null, or
    without an id, and containers of no capacity have no row; ids are unique. Ties of size go by the id's hash order within a task.

    Pieces are dealt by a hash to tasks of a bounded number of pieces; containers that a task leaves under-filled are packed again together.
    """
    kinds = containers.select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).where((F.col("capacity") > 0) & F.col("kind").isNotNull()).distinct()
    extra = [F.col(cluster).cast("string").alias("cluster") if cluster else F.lit(None).cast("string").alias("cluster"), F.col(source).cast("string").alias("source") if source else F.lit(None).cast("string").alias("source")]
    sized = items.select(F.col(id).alias("id"), F.col(size).cast("long").alias("whole"), *extra).where(F.col("id").isNotNull() & (F.col("whole") > 0))
    each = materialize(sized).crossJoin(F.broadcast(kinds))  # one row a kind of container
    last = F.floor((F.col("whole") - 1) / F.col("capacity")).cast("int")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    each = each.withColumn("size", F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity"))).drop("whole")
    full = each.where(F.col("size") == F.col("capacity"))
    each = materialize(each.where(F.col("size") < F.col("capacity")))
    with_source = source is not None
    schema = f"kind {kinds.schema['kind'].dataType.simpleString()}, capacity long, id {sized.schema['id'].dataType.simpleString()}, piece int, size long, cluster string, source string, container string, position int, filled long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        groups = [None if not isinstance(c, str) else c for c in pdf["cluster"]]
        at = best_fit(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]), groups, [None if not isinstance(x, str) else x for x in pdf["source"]] if with_source else None, per_source)
        pdf["container"] = [f"{n}-{b}" for n, b in zip(pdf["name"], at, strict=True)]
        pdf["position"] = pdf.groupby("container").cumcount().astype("int32")
        pdf["filled"] = pdf.groupby("container")["size"].transform("sum")
        return pdf[["kind", "capacity", "id", "piece", "size", "cluster", "source", "container", "position", "filled"]]

    def round_(pieces: DataFrame, mark: str) -> DataFrame:
        n = pieces.groupBy("kind").agg(F.greatest(F.ceil(F.count("*") / shard), F.lit(1)).cast("int").alias("tasks"))
        dealt = pieces.join(F.broadcast(n), "kind").withColumn("task", F.pmod(F.xxhash64("id", "piece"), F.col("tasks")).cast("int")).drop("tasks")
        dealt = dealt.withColumn("name", F.concat(F.lit(mark), F.col("task").cast("string")))
        return materialize(dealt.groupBy("kind", "task").applyInPandas(one, schema))

    first = round_(each, "a")
    loose = F.col("filled") < F.col("capacity") * FULL
    again = round_(first.where(loose).select("kind", "capacity", "id", "piece", "size", "cluster", "source"), "b")
    alone = full.select("kind", "capacity", "id", "piece", "size", "cluster", "source", F.concat(F.lit("f"), F.xxhash64("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("position"), F.col("capacity").alias("filled"))
    out = first.where(~loose).unionByName(again).unionByName(alone)
    return out.select(F.col("kind").alias(kind), F.col("container").alias("container_id"), "position", F.col("id").alias(id), "piece", "size")


def fill_rates(packed: DataFrame, containers: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """Columns {kind}, n_containers, n_pieces, used (tokens) and fill, the used share of all capacity."""
    used = packed.groupBy(kind).agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("size").alias("used"))
    caps = containers.groupBy(kind).agg(F.max(capacity).alias("capacity"))
    return used.join(F.broadcast(caps), kind).select(kind, "n_containers", "n_pieces", "used", (F.col("used") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
