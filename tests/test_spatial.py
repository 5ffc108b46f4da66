import math
import random

from pyspark.sql import functions as F

from kinweave.operators.linkers import CoordinateLinker
from kinweave.operators.spatial import haversine_km, pairs_within, points_in_regions
from kinweave.runtime import once

NAN, INF = float("nan"), float("inf")


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def found(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_pairs_equal_brute_force_everywhere(table):
    rng = random.Random(1)
    points = []
    for lat, lon in ((52.0, 13.0), (0.0, 180.0), (89.9999, 10.0), (-90.0, 0.0), (60.0, -179.9999)):
        points += [(lat + rng.uniform(-0.01, 0.01) if abs(lat) < 89 else max(-90.0, min(90.0, lat + rng.uniform(-0.003, 0.0001))), lon + rng.uniform(-0.01, 0.01) * (1 if abs(lat) < 89 else 18000)) for _ in range(60)]
    rows = [(i, *p) for i, p in enumerate(points)]
    df = table(rows, "record_id long, lat double, lon double")
    want = sorted((i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if km(points[i], points[j]) <= 0.25)
    assert len(want) > 100
    assert found(pairs_within(df, km=0.25)) == want
    turned = df.withColumn("lon", F.col("lon") + 360.0)
    assert found(pairs_within(turned, km=0.25)) == want


def test_two_tables_and_other_distances(table):
    rng = random.Random(2)
    a = [(i, rng.uniform(40, 40.5), rng.uniform(5, 5.5)) for i in range(80)]
    b = [(i + 1000, rng.uniform(40, 40.5), rng.uniform(5, 5.5)) for i in range(80)]
    schema = "record_id long, lat double, lon double"
    for d in (0.5, 7.0, 3000.0):
        want = sorted((x[0], y[0]) for x in a for y in b if km(x[1:], y[1:]) <= d)
        assert found(pairs_within(table(a, schema), table(b, schema), km=d)) == want


def test_impossible_values_ties_and_clashing_columns(table):
    rows = [(1, 10.0, 20.0, "x"), (2, 10.0, 20.0, "x"), (2, 10.0, 20.0, "y"), (3, None, 20.0, ""), (4, 10.0, NAN, ""), (5, 91.0, 20.0, ""), (6, 10.0, INF, ""), (None, 10.0, 20.0, ""), (7, 10.0, 380.0, "")]
    df = table(rows, "record_id long, lat double, lon double, block string")
    assert found(pairs_within(once(df, "record_id", "lat", "lon"))) == [(1, 2), (1, 7), (2, 7)]
    assert found(pairs_within(once(df.limit(0), "record_id", "lat", "lon"))) == []


def test_a_crowded_place_is_split(table, spark, monkeypatch):
    from kinweave.operators import spatial

    monkeypatch.setattr(spatial, "SPLIT", 20)
    df = spark.range(150).select(F.col("id").alias("record_id"), F.lit(50.0).alias("lat"), F.lit(8.0).alias("lon"))
    assert pairs_within(df).distinct().count() == 150 * 149 // 2 == pairs_within(df).count()


def test_haversine(table):
    df = table([(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 0.0, 90.0), (5.0, 6.0, 5.0, 6.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert abs(got[0] - 20015.0868) < 1e-3 and abs(got[1] - 10007.5434) < 1e-3 and got[2] == 0 and got[3] is None


def inside(p, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a > p[0]) != (c > p[0]) and p[1] < (d - b) * (p[0] - a) / (c - a) + b:
            odd = not odd
    return odd


def test_regions_equal_brute_force(table):
    rng = random.Random(3)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(400)]
    rings = {"big": [(-2.5, -2.5), (-2.5, 2.5), (2.5, 2.5), (0.0, 0.0), (2.5, -2.5)], "small": [(0.1, 0.1), (0.1, 0.4), (0.5, 0.2)], "tiny": [(1.0, 1.0), (1.0, 1.0001), (1.0001, 1.0)], "line": [(0.0, 0.0), (1.0, 1.0)]}
    regions = table([(k, [{"lat": a, "lon": b} for a, b in r]) for k, r in rings.items()] + [(None, None)], "region_id string, ring array<struct<lat: double, lon: double>>")
    df = table([*points, (900, None, 1.0), (None, 0.0, 0.0)], "record_id long, lat double, lon double")
    want = sorted((i, k) for i, *p in points for k, r in rings.items() if len(r) > 2 and inside(p, r))
    assert found(points_in_regions(df, regions)) == want
    assert found(points_in_regions(df, regions.limit(0))) == []


def test_thin_and_crowded_regions(table):
    rng = random.Random(9)
    thin = [(-60.0, -150.0), (60.0, 150.0), (60.001, 150.0), (-59.999, -150.0)]
    town = [(48.1, 11.4), (48.1, 11.7), (48.3, 11.7), (48.3, 11.4)]
    along = [(i, -60 + 120 * t, -150 + 300 * t + rng.uniform(-0.002, 0.002)) for i, t in enumerate(rng.random() for _ in range(300))]
    crowd = [(1000 + i, rng.uniform(48.05, 48.35), rng.uniform(11.35, 11.75)) for i in range(400)] + [(2000 + i, 48.2, 11.5) for i in range(200)]
    rings = {"thin": thin, "town": town}
    regions = table([(k, [{"lat": a, "lon": b} for a, b in r], 7) for k, r in rings.items()], "region_id string, ring array<struct<lat: double, lon: double>>, code int")
    df = table([(*p, "x") for p in along + crowd], "record_id long, lat double, lon double, block string")
    want = sorted((i, k) for i, *p in along + crowd for k, r in rings.items() if inside(p, r))
    assert {k for _, k in want} == {"thin", "town"}
    for split in (40, 10_000):
        assert found(points_in_regions(df, regions, split=split)) == want


def test_cover_holds_a_polygon():
    from kinweave.operators.spatial import COVER, cover

    ranges = cover([10.0, 10.0, 12.0, 12.0], [20.0, 23.0, 23.0, 20.0])
    assert 4 < len(ranges) <= COVER and any(w for *_, w in ranges) and all(a <= b for _, a, b, _ in ranges)
    assert all(x[2] < y[1] for x, y in zip(ranges, ranges[1:], strict=False))


def test_coordinate_linker_exact(table):
    a = table([(1, 10.0, 20.0), (2, 10.0005, 20.0)], "record_id long, lat double, lon double")
    assert found(CoordinateLinker(0.1, exact=True)(a, a).links) == [(1, 2)]
    assert CoordinateLinker(0.1)(a, a).links.count() in (0, 1)
