"""Queries on coordinates (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators.spatial import pairs_within
from kinweave.runtime import once


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    points = once(spark.read.parquet(f"{d}/coordinates.parquet"), "record_id", "lat", "lon")
    return pairs_within(points, km=0.25).select("record_id_l", "record_id_r")


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH p AS (SELECT DISTINCT record_id, lat, lon - 360 * floor((lon + 180) / 360) AS lon FROM coordinates
  WHERE record_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND NOT isnan(lat) AND NOT isnan(lon) AND lon IS NOT NULL),
g AS (SELECT *, CAST(floor(lat / 0.0023) AS BIGINT) AS cell FROM p),
n AS (SELECT *, cell + d AS near FROM g, (VALUES (-1), (0), (1)) AS v(d)),
m AS (SELECT a.record_id AS record_id_l, b.record_id AS record_id_r,
  2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
  FROM n a JOIN g b ON a.near = b.cell AND a.record_id < b.record_id)
SELECT record_id_l, record_id_r FROM m WHERE km <= 0.25"""
}
