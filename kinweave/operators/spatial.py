"""Neighbours within a distance, and the regions that hold a point, by cells of a space-filling curve.

Points are placed on the sphere in space (x, y, z), so neither the poles nor the longitude of 180 degrees is special. A cell's
identifier is its Morton code (bits of the three indices interleaved). A disc is covered with ranges of codes, each within one
block of 8 x 8 x 8 cells; ranges meet points by block and code, and what meets is measured exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import materialize

RADIUS_KM = 6371.0
#: A block with at least this many points is split among tasks.
SPLIT = 2_000
#: Cells of which a region's cover consists at most, and the finest level of the quadtree of degrees.
COVER, FINEST = 96, 20
#: The masks that spread 21 bits to every third bit.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))

#: The masks that spread 32 bits to every other bit.
FLAT = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaves the low 21 bits of three non-negative longs; grows with each of them."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def _flat(c: Column) -> Column:
    """Spreads the low 22 bits of a non-negative long to every other bit."""
    for shift, mask in FLAT:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    """Distance along the surface of a sphere. Null in, null out."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def usable(lat: Column, lon: Column) -> Column:
    """Both finite, and the latitude possible; any finite longitude is."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0)
    return ok & (F.abs(lon) < F.lit(float("inf")))


def _placed(points: DataFrame, cell_km: float) -> DataFrame:
    """id, lat, lon with x, y, z in km from the sphere's corner, and the cell's code."""
    p, q = F.radians("lat"), F.radians("lon")
    at = points.select(
        "*",
        (F.cos(p) * F.cos(q) * RADIUS_KM + RADIUS_KM).alias("x"),
        (F.cos(p) * F.sin(q) * RADIUS_KM + RADIUS_KM).alias("y"),
        (F.sin(p) * RADIUS_KM + RADIUS_KM).alias("z"),
    )
    index = [F.greatest(F.floor(F.col(a) / cell_km), F.lit(0)).cast("long") for a in "xyz"]
    return at.withColumn("code", morton(*index)).withColumn("block", F.shiftright("code", 9))


def _ranges(placed: DataFrame, reach: float, cell_km: float, only_after: bool) -> DataFrame:
    """A row for each block that a point's disc may meet, with the first and last code in it."""
    top = F.lit(2**21 - 1)
    out = placed
    for a in "xyz":
        lo, hi = (F.floor((F.col(a) + d) / cell_km).cast("long") for d in (-reach, reach))
        out = out.withColumn(f"{a}0", F.greatest(lo, F.lit(0)).cast("long")).withColumn(f"{a}1", F.least(hi, top).cast("long"))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    parts = []
    for bit, a in enumerate("xyz"):
        block = F.shiftright(f"{a}0", 3) + F.shiftright("k", bit).bitwiseAND(F.lit(1)).cast("long")
        out = out.withColumn(f"{a}b", block)
        parts.append(F.col(f"{a}b") <= F.shiftright(f"{a}1", 3))
    out = out.where(parts[0] & parts[1] & parts[2])
    side = 8 * cell_km
    middle = sum((F.pow((F.col(f"{a}b") + 0.5) * side - RADIUS_KM, 2) for a in "xyz"), F.lit(0.0))
    out = out.where(F.abs(F.sqrt(middle) - RADIUS_KM) <= side * 0.8661)  # a block off the surface has no points
    first = morton(*[F.greatest(F.col(f"{a}0"), F.shiftleft(f"{a}b", 3)) for a in "xyz"])
    last = morton(*[F.least(F.col(f"{a}1"), F.shiftleft(f"{a}b", 3) + 7) for a in "xyz"])
    # behind an explode, the codes are computed once: else the condition on the block would be pushed down with all of their terms
    out = out.withColumn("r", F.explode(F.array(F.struct(first.alias("code_from"), last.alias("code_to")))))
    out = out.withColumn("code_from", F.col("r.code_from")).withColumn("code_to", F.col("r.code_to")).withColumn("block_of", F.shiftright("code_from", 9)).drop("r")
    return out.where(F.col("block_of") >= F.col("block")) if only_after else out


def pairs_within(left: DataFrame, right: DataFrame | None = None, km: float = 0.25, id: str = "record_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of points at most `km` apart: columns {id}_l, {id}_r and km.

    Without `right`, pairs of different points of `left`, smaller id first, each once; else all pairs of a left and a right point.
    Ids are unique (use runtime.once before). Points with a null id, a null, NaN or infinite coordinate or an impossible latitude take no
    part; longitudes count modulo 360. Equal positions are pairs at distance 0. An empty table gives no pairs. Other columns are ignored.
    Blocks that hold many points are split among tasks: their ranges by a hash of the id, their points copied to every part.
    """
    if not km > 0:
        raise ValueError("km must be positive")
    reach = 2 * RADIUS_KM * math.sin(min(km / (2 * RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-9
    cell_km = max(reach / 4, 2 * RADIUS_KM / (2**21 - 8))

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        return _placed(df.where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))), cell_km)

    same = right is None
    a = clean(left)
    b = a if same else clean(right)
    counts = b.groupBy("block").agg(F.count("*").alias("n"))
    crowded = counts.where(F.col("n") >= SPLIT).select(F.col("block").alias("block_of"), F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    points = b.select(F.col("id").alias("r_id"), F.col("block").alias("block_of"), F.col("code").alias("r_code"), *[F.col(c).alias(f"r_{c}") for c in ("lat", "lon", "x", "y", "z")])
    points = points.join(crowded, "block_of", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    asks = _ranges(a, reach, cell_km, same).select("id", "lat", "lon", "x", "y", "z", "block", "block_of", "code_from", "code_to")
    asks = asks.join(crowded, "block_of", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    near = F.pow(F.col("x") - F.col("r_x"), 2) + F.pow(F.col("y") - F.col("r_y"), 2) + F.pow(F.col("z") - F.col("r_z"), 2) <= reach * reach
    met = asks.join(points, ["block_of", "part"]).where(F.col("r_code").between(F.col("code_from"), F.col("code_to")) & near)
    if same:
        met = met.where((F.col("block_of") > F.col("block")) | (F.col("id") < F.col("r_id")))
    met = met.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("km") <= km)
    ends = (F.least("id", "r_id"), F.greatest("id", "r_id")) if same else (F.col("id"), F.col("r_id"))
    return met.select(ends[0].alias(f"{id}_l"), ends[1].alias(f"{id}_r"), "km")


def cover(lat: list[float], lon: list[float], most: int = COVER) -> list[tuple[int, int, int, bool]]:
    """Ranges of codes at the level FINEST that hold a polygon: level of the region, first and last code, and whether all within it is inside.

    The cells of the bounding box's level that the polygon meets are quartered while there are at most `most`; those that no edge meets are inside or left out. Cells
    that follow each other on the curve become one range. The level is even and its cells are at least as large as the box, which so lies in four of them at most.
    """
    y, x = np.asarray(lat, float), np.asarray(lon, float)
    y2, x2 = np.roll(y, -1), np.roll(x, -1)
    span = max(np.ptp(y), np.ptp(x), 1e-9)
    level = max(0, min(FINEST, math.floor(math.log2(360.0 / span)))) // 2 * 2

    def met(r: int, c: int, size: float) -> bool:
        """Whether an edge meets the closed cell."""
        south, west = r * size - 90.0, c * size - 180.0
        lo, hi = np.zeros(len(x)), np.ones(len(x))
        ok = np.ones(len(x), bool)
        for a, b, least, greatest in ((y, y2, south, south + size), (x, x2, west, west + size)):
            d = b - a
            with np.errstate(divide="ignore", invalid="ignore"):
                t0, t1 = (least - a) / d, (greatest - a) / d
            flat = d == 0
            ok &= ~flat | ((a >= least) & (a <= greatest))
            lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(t0, t1)))
        return bool((ok & (lo <= hi)).any())

    def inside(r: int, c: int, size: float) -> bool:
        a, b = (r + 0.5) * size - 90.0, (c + 0.5) * size - 180.0
        up = (y > a) != (y2 > a)
        return bool((up & (b < (x2 - x) * (a - y) / np.where(y2 == y, 1.0, y2 - y) + x)).sum() % 2)

    size = 360.0 / 2**level
    rows = range(math.floor((y.min() + 90.0) / size), math.floor((y.max() + 90.0) / size) + 1)
    columns = range(math.floor((x.min() + 180.0) / size), math.floor((x.max() + 180.0) / size) + 1)
    edge, full, at = [(r, c) for r in rows for c in columns], [], level
    edge = [k for k in edge if met(*k, size)]
    while at < FINEST and len(full) + 4 * len(edge) <= most:
        at, size = at + 1, size / 2
        quarters = [(2 * r + i, 2 * c + j) for r, c in edge for i in (0, 1) for j in (0, 1)]
        edge = []
        for k in quarters:
            if met(*k, size):
                edge.append(k)
            elif inside(*k, size):
                full.append((at, k))
    spread = lambda v: sum((v >> i & 1) << 2 * i for i in range(FINEST + 2))
    cells = sorted([(spread(c) << 1 | spread(r), l, True) for l, (r, c) in full] + [(spread(c) << 1 | spread(r), at, False) for r, c in edge], key=lambda k: k[0] << 2 * (FINEST - k[1]))
    out: list[tuple[int, int, int, bool]] = []
    for code, l, whole in cells:
        shift = 2 * (FINEST - l)
        first, last, block = code << shift, ((code + 1) << shift) - 1, 2 * (FINEST - level)
        if out and out[-1][2] + 1 == first and out[-1][3] == whole and out[-1][1] >> block == first >> block:
            first = out.pop()[1]
        out.append((level, first, last, whole))
    return out


def points_in_regions(points: DataFrame, regions: DataFrame, id: str = "record_id", region: str = "region_id", lat: str = "lat", lon: str = "lon", ring: str = "ring", split: int = SPLIT) -> DataFrame:
    """The regions that hold each point: columns {id} and {region}.

    `ring` is an array of structs (lat, lon), the corners of a simple polygon in plain degrees that does not cross longitude 180. A point
    has the Morton code of its finest cell, a region the ranges of codes that cover it (see cover()); they meet by the cell of the region's level that both
    lie in, and by code. What is in a range that is wholly inside needs no further test, the rest is tested exactly by counting crossed edges. A point on an edge
    belongs to the regions above or to the right of it. Points are looked up once for each even level that regions have, eleven at most. Cells with more than
    `split` points are split by a hash of the id, and their ranges copied. Null, NaN and impossible coordinates, null ids and rings of under three corners give no row.
    """
    kind = regions.schema[region].dataType.simpleString()
    corners = lambda f: F.transform(F.col("ring"), lambda p: p[f].cast("double"))
    rings = regions.select(F.col(region).alias("region"), F.col(ring).alias("ring")).where(F.col("region").isNotNull() & (F.size("ring") >= 3))
    rings = rings.select("region", corners("lat").alias("lats"), corners("lon").alias("lons"))

    def covered(batches):
        for pdf in batches:
            rows = []
            for r, a, b in zip(pdf["region"], pdf["lats"], pdf["lons"], strict=True):
                if np.isfinite(np.asarray(a, float)).all() and np.isfinite(np.asarray(b, float)).all():
                    rows += [(r, a, b, *x) for x in cover(a, b)]
            yield pd.DataFrame(rows, columns=["region", "lats", "lons", "level", "code_from", "code_to", "whole"])

    box = rings.mapInPandas(covered, f"region {kind}, lats array<double>, lons array<double>, level int, code_from long, code_to long, whole boolean")
    after = lambda c, i: F.get(c, F.pmod(i + 1, F.size(c)))
    edges = F.transform(F.sequence(F.lit(0), F.size("lats") - 1), lambda i: F.struct(F.get("lats", i).alias("a"), F.get("lons", i).alias("b"), after("lats", i).alias("c"), after("lons", i).alias("d")))
    box = materialize(box.withColumn("edges", F.when(~F.col("whole"), edges)).drop("lats", "lons"))
    block = lambda c: F.call_function("shiftright", F.col(c), (2 * (FINEST - F.col("level"))).cast("int"))
    box = box.withColumn("block", block("code_from"))
    used = F.broadcast(box.select("level").distinct())  # eleven rows at most
    p = points.select(F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))).withColumn("lon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    cell = lambda v, shift: F.floor((v + shift) / (360.0 / 2**FINEST)).cast("long")
    p = p.withColumn("code", _flat(cell(F.col("lat"), 90.0)).bitwiseOR(F.shiftleft(_flat(cell(F.col("lon"), 180.0)), 1)))
    p = p.crossJoin(used).withColumn("block", block("code"))
    key = ["level", "block"]
    crowded = p.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > split).select(*key, F.ceil(F.col("n") / split).cast("int").alias("parts"))
    crowded = materialize(crowded.join(box.select(*key).distinct(), key, "left_semi"))
    parts = F.coalesce("parts", F.lit(1))
    p = p.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    box = box.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = p.join(box, [*key, "part"]).where(F.col("code").between(F.col("code_from"), F.col("code_to")))
    crossed = lambda e: ((e["a"] > F.col("lat")) != (e["c"] > F.col("lat"))) & (F.col("lon") < (e["d"] - e["b"]) * (F.col("lat") - e["a"]) / F.when(e["c"] == e["a"], F.lit(1.0)).otherwise(e["c"] - e["a"]) + e["b"])
    inside = F.col("whole") | (F.size(F.filter("edges", crossed)) % 2 == 1)
    return met.where(inside).select(F.col("id").alias(id), F.col("region").alias(region))
