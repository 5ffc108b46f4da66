"""Tables that describe a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Columns value, n, rank (from 0, most frequent first, equal ones by value) and pct, the percentage of all rows.

    Ranks count the values that come before, by the number of values of each n, so that no task sorts all values.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    by_n = counts.groupBy("n").agg(F.count("*").alias("k"))
    # there are far fewer different counts than values: at most the square root of twice the rows
    before = by_n.withColumn("first", F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)))
    total = df.agg(F.count("*").alias("n_all"))
    placed = counts.join(before.select("n", F.coalesce("first", F.lit(0)).alias("first")), "n")
    rank = F.col("first") + F.row_number().over(Window.partitionBy("n").orderBy("value")) - 1
    out = placed.withColumn("rank", rank.cast("long")).crossJoin(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("n_all"))
    out = out.select("value", "n", "rank", "pct")
    return out if limit is None else out.where(F.col("rank") < limit)


def counts_histogram(counts: DataFrame) -> DataFrame:
    """Of a table with the column n: columns n, n_keys with this n, and n_rows, their sum."""
    return counts.groupBy("n").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


def column_summary(df: DataFrame) -> DataFrame:
    """A row a column: rows, nulls and different values (exact)."""
    out = None
    for c in df.columns:
        part = df.agg(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"), F.countDistinct(c).alias("n_distinct"))
        out = part if out is None else out.unionByName(part)
    return out
