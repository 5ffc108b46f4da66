"""Groups of records that pairwise matches link, directly or through others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import lookup, materialize, parallelism

#: Edges that one task holds at most.
EDGES = 1_000_000
#: Fixed value: an odd constant, the golden ratio in 64 bits, for mixing ids.
MIX = 0x9E3779B97F4A7C15


def _order(nodes: np.ndarray, salt: int) -> np.ndarray:
    """Ranks of sorted distinct nodes; by value for salt 0, else by a hash, so that long chains of ascending ids shorten fast too."""
    if not salt or nodes.dtype.kind not in "iu":
        return np.arange(len(nodes))
    x = nodes.astype(np.uint64) * np.uint64(MIX) + np.uint64((salt * MIX) % 2**64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    rank = np.empty(len(nodes), np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(len(nodes))
    return rank


def union_find(left: np.ndarray, right: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and of each the root of its tree: a spanning forest of depth one. Roots come first in the order of `salt`."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    rank = _order(nodes, salt)
    by_rank = np.empty(len(nodes), np.int64)
    by_rank[rank] = np.arange(len(nodes))
    ends = rank[ends.reshape(-1)]
    a, b = ends[: len(left)], ends[len(left) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[by_rank[parent[rank]]]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forests(edges: DataFrame, kind: str, salt: int) -> DataFrame:
    """Each partition's spanning forest, as a row (node, root) for each node, roots included."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            t = pa.Table.from_batches(tables).combine_chunks()
            left, right = (t.column(i).to_numpy() for i in (0, 1))
            node, root = union_find(left, right, salt)
            out = pa.table({"node": pa.array(node, t.schema.field(0).type), "root": pa.array(root, t.schema.field(0).type)})
            yield from out.to_batches(max_chunksize=65_536)

    return edges.mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(links: DataFrame, left: str = "record_id_l", right: str = "record_id_r", id: str = "record_id", group: str = "group_id", edges_per_task: int = EDGES) -> DataFrame:
    """Columns {id} and {group}: every id on either side of `links`, with the least id of its group.

    A row with both sides links them; one with a missing side only names the other, one with equal sides only itself; rows without
    any id name nothing. Repeated, mirrored and extra columns don't matter; an empty table gives no rows. Ids are integers or strings.

    Each task runs union-find over a bounded number of edges and keeps a spanning forest. A node that one forest alone
    holds is settled by its root; nodes of several forests link their roots, and these links are the next round's edges, until
    they fit one bounded task. Groups of any size pass through bounded tasks only; labels return through the same rounds.
    """
    spark = links.sparkSession
    kind = links.schema[left].dataType.simpleString()
    both = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    edges = both.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    n = edges.count()
    named = both.select(F.explode(F.array("a", "b")).alias("node")).where(F.col("node").isNotNull())
    rounds: list[DataFrame] = []
    parts = max(parallelism(spark), -(-n // edges_per_task))
    while n > 0:
        alone = bool(rounds) and n <= edges_per_task
        spread = edges.coalesce(1) if alone else edges.repartition(parts, "a", "b")
        forest = _forests(spread, kind, 0 if alone else len(rounds) + 1)
        if alone:
            rounds.append(materialize(forest))
            break
        roots = materialize(forest.groupBy("node").agg(F.collect_set("root").alias("roots")))  # of each node at most one a task
        rounds.append(roots.select("node", F.array_min("roots").alias("root")))
        edges = roots.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.array_min("roots").alias("b"))
        edges = materialize(edges.where(F.col("a") != F.col("b")).distinct())
        n = edges.count()
        parts = max(1, min(parts, -(-2 * n // edges_per_task)))
    if not rounds:
        return named.distinct().select(F.col("node").alias(id), F.col("node").alias(group))
    labels = rounds[-1]
    for r in reversed(rounds[:-1]):
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("label"))
        labels = materialize(lookup(r, up, "root", "left").select("node", F.coalesce("label", "root").alias("root")))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    grouped = lookup(labels, least, "root").select("node", "least")
    single = named.distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("least"))
    return grouped.unionByName(single).select(F.col("node").alias(id), F.col("least").alias(group))
