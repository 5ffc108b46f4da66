"""Samples of rows and of pairs, repeatable by a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.model import warn_many
from kinweave.runtime import numbered


def sample_table(df: DataFrame, n: int, method: str | None = None, seed: int = 0) -> DataFrame:
    """About n rows ("row", "block") or just n of them in the order of a hash of all columns ("hash"), which doesn't depend on partitions.

    By default "row" up to 16,384 rows, else "block". "row" draws each row by itself; "block" takes whole partitions of the table as read, in the order of a hash
    of their numbers, until they hold n rows: few files are read, but neighbours come together.
    """
    method = method or ("row" if n <= 16_384 else "block")
    if method == "hash":
        plain = [c for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]
        return df.orderBy(F.xxhash64(F.lit(seed), *plain), *plain).limit(n)
    if method not in ("row", "block"):
        raise ValueError(f"method is 'row', 'block' or 'hash', not {method!r}")
    if method == "block":
        part = df.withColumn("__part", F.spark_partition_id())
        sizes = sorted(((r["__part"], r["n"]) for r in part.groupBy("__part").agg(F.count("*").alias("n")).collect()), key=lambda x: hash((seed, x[0])))  # one row a partition
        kept, held = [], 0
        for k, size in sizes:
            if held < n:
                kept.append(k)
                held += size
        return part.where(F.col("__part").isin(kept)).drop("__part")
    total = df.count()
    return df if total <= n else df.sample(fraction=min(1.0, n / total), seed=seed)


def sample_all_links(left: DataFrame, right: DataFrame, max_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """Columns record_id_l, record_id_r: just min(all, max_pairs) different pairs, drawn evenly from all, self pairs included.

    Pairs are numbered from 0 to n·m - 1; a bijection of the numbers (an affine map modulo n·m) gives the drawn ones without a list of all. Each
    number then meets the rows' ranks. Without max_pairs all pairs result, as a product.
    """
    n, m = left.count(), right.count()
    total = n * m
    if max_pairs is None or total <= max_pairs:
        warn_many(total)
        return left.select(F.col("record_id").alias("record_id_l")).crossJoin(right.select(F.col("record_id").alias("record_id_r")))
    warn_many(max_pairs)
    spark = left.sparkSession
    step = int(total * 0.6180339887498949) + 2 * seed + 1
    while math.gcd(step, total) != 1:
        step += 1
    drawn = spark.range(max_pairs).select(F.expr(f"pmod(cast(id as decimal(38, 0)) * {step} + {seed * 104_729 + 12_345}, {total})").cast("long").alias("k"))
    drawn = drawn.select(F.expr(f"k div {m}").alias("i"), F.expr(f"pmod(k + k div {m}, {m})").alias("j"))

    def ranked(df: DataFrame, name: str, rank: str) -> DataFrame:
        return numbered(df.select(F.col("record_id").alias(name)), [F.xxhash64(F.lit(seed), name), F.col(name)], rank)

    return drawn.join(ranked(left, "record_id_l", "i"), "i").join(ranked(right, "record_id_r", "j"), "j").select("record_id_l", "record_id_r")
