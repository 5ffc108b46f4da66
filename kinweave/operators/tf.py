"""How frequent values are, and what follows from it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.runtime import lookup


def stats_table(df: DataFrame, column: str) -> DataFrame:
    """Columns value, count and frequency, the share of all rows; null is a value."""
    total = df.agg(F.count("*").alias("n_all"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("n_all")).alias("frequency"))


def add_frequencies(df: DataFrame, stats: DataFrame, column: str, name: str | None = None, default: float | None = None) -> DataFrame:
    """df with the frequency of its values; values that the stats lack get the default, or one over the number of rows of df. Null stays null."""
    name = name or f"{column}_frequency"
    known = stats.where(F.col("value").isNotNull()).select(F.col("value").alias(column), F.col("frequency").alias("__f"))
    out = lookup(df, known, column, "left")
    if default is None:
        total = df.agg((F.lit(1.0) / F.greatest(F.count("*"), F.lit(1))).alias("__d"))
        out = out.crossJoin(F.broadcast(total))
    else:
        out = out.withColumn("__d", F.lit(float(default)))
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce("__f", "__d"))).select(*df.columns, name)


@dataclass(frozen=True)
class TermFrequencyModel:
    """Stats of several columns; the frequency of a row is the product of its values' frequencies."""

    stats: Mapping[str, DataFrame]

    @classmethod
    def from_table(cls, df: DataFrame, *columns: str) -> TermFrequencyModel:
        return cls({c: stats_table(df, c) for c in columns})

    def add_frequency(self, df: DataFrame, name: str = "frequency", default: float | None = None) -> DataFrame:
        out, product = df, F.lit(1.0)
        for c, s in self.stats.items():
            out = add_frequencies(out, s, c, f"__{c}_f", default)
            product = product * F.col(f"__{c}_f")
        return out.withColumn(name, product).select(*df.columns, name)


def keep_rare(needles: DataFrame, haystack: DataFrame, columns: list[str], max_frequency: float) -> DataFrame:
    """The needles whose values are rare together in the haystack: their frequencies' product is at most max_frequency."""
    scored = TermFrequencyModel.from_table(haystack, *columns).add_frequency(needles, "__frequency")
    return scored.where(F.col("__frequency") <= max_frequency).drop("__frequency")


def keep_unambiguous(haystack: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of which no other has the same values in these columns."""
    return haystack.withColumn("__n", F.count("*").over(Window.partitionBy(*columns))).where(F.col("__n") == 1).drop("__n")


def ambiguous(haystack: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that share their values in these columns with another."""
    return haystack.withColumn("__n", F.count("*").over(Window.partitionBy(*columns))).where(F.col("__n") > 1).drop("__n")
