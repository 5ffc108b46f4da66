"""Linking a stream of records with a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_stream(stream: DataFrame, stored: DataFrame, keys: list[str], id: str = "record_id") -> DataFrame:
    """Columns {id}_l and {id}_r of streamed and stored records that agree in all keys; null keys never do. Each micro-batch joins the stored table."""
    left = stream.select(F.col(id).alias(f"{id}_l"), *keys).dropna(subset=keys)
    right = stored.select(F.col(id).alias(f"{id}_r"), *keys).dropna(subset=keys)
    return left.join(right, keys).select(f"{id}_l", f"{id}_r")


def rolling_counts(stream: DataFrame, key: str, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Columns window, {key} and n: records by window of time and key, with rows up to `late` behind the latest."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n"))
