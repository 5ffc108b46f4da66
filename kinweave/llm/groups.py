"""All pairs within groups, without a large group's pairs in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import materialize

#: Members of a group that one task meets at a time.
BLOCK = 500


def pairs_of_groups(members: DataFrame, id: str, group: str, block: int = BLOCK) -> DataFrame:
    """Columns {id}_l and {id}_r, smaller first: the pairs of different members of each group; (id, group) rows are distinct.

    A group of over `block` members is split into blocks by a hash, and pairs of blocks are spread over the tasks.
    """
    m = members.select(F.col(id).alias("id"), F.xxhash64(group).alias("h"), F.col(group).alias("g"))
    size = m.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    m = m.join(size, ["h", "g"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    m = m.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n")
    # a member of block p meets block q once: as the left side under (p, q) for q >= p, as the right side under (q, p) for q <= p
    left = m.withColumn("other", F.explode(F.sequence("part", F.col("blocks") - 1)))
    right = m.select("g", "h", F.col("id").alias("id_r"), F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), "part")).alias("part"))
    met = left.join(right, ["h", "g", "part", "other"]).where((F.col("part") != F.col("other")) | (F.col("id") < F.col("id_r")))
    return met.select(F.least("id", "id_r").alias(f"{id}_l"), F.greatest("id", "id_r").alias(f"{id}_r"))


def pairs_of_buckets(left: DataFrame, right: DataFrame, key: str = "key", id_l: str = "id_l", id_r: str = "id_r", block: int = 4 * BLOCK) -> DataFrame:
    """The columns of both tables for each left and right row with the same key; `key` is dropped, as are rows with a null key.

    A bucket of more than `block` rows is split on both sides by a hash of the id, and each pair of its blocks meets in a task of its own choice. Which
    buckets are large is counted first, and where there is none, one join does all.
    """
    n = left.select(key).unionAll(right.select(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    large = materialize(n.where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        return left.join(right, key).drop(key)
    part = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = left.join(large, key).withColumn("part_l", part(id_l)).withColumn("part_r", every).drop("blocks")
    b = right.join(large, key).withColumn("part_r", part(id_r)).withColumn("part_l", every).drop("blocks")
    rest = left.join(large, key, "left_anti").join(right.join(large, key, "left_anti"), key).drop(key)
    return rest.unionByName(a.join(b, [key, "part_l", "part_r"]).drop(key, "part_l", "part_r"))
