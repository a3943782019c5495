"""Points in rings of many edges against the plain test over all edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import polygons

RING = "gid bigint, ring array<struct<lon: double, lat: double>>"
POINT = "pid bigint, lat double, lon double"


def inside(ring, lat, lon):
    """Odd number of crossings, for arrays of points."""
    x, y = np.array(ring, dtype=float).T
    if (x[0], y[0]) != (x[-1], y[-1]):
        x, y = np.append(x, x[0]), np.append(y, y[0])
    n = np.zeros(len(lat), dtype=int)
    for px, py, qx, qy in zip(x, y, x[1:], y[1:]):
        if py != qy:
            n += ((py > lat) != (qy > lat)) & (lon < px + (lat - py) / (qy - py) * (qx - px))
    return n % 2 == 1


def check(spark, rings, lat, lon):
    """The index alone, and rings of both kinds."""
    shapes = spark.createDataFrame([(g, [tuple(map(float, v)) for v in ring]) for g, ring in rings.items()], RING)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], POINT)
    want = {(int(i), g) for g, ring in rings.items() for i in np.flatnonzero(inside(ring, lat, lon))}
    for short in (0, 64):
        got = [tuple(r) for r in polygons.containing(points, shapes, "pid", "gid", short).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    return want


def wavy(n, cx, cy, radius, rng):
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = radius * (1 + 0.3 * np.sin(7 * t) + 0.02 * rng.standard_normal(n))
    ring = [(cx + a * math.cos(b), cy + a * math.sin(b)) for a, b in zip(r, t)]
    return ring + ring[:1]


def test_long_rings(spark):
    rng = np.random.default_rng(5)
    rings = {1: wavy(5000, 10.0, 45.0, 8.0, rng), 2: wavy(3000, 10.0, 45.0, 0.02, rng), 3: wavy(400, -70.0, -10.0, 20.0, rng)}
    lat = np.concatenate([rng.uniform(30, 60, 400), 45 + rng.normal(0, 0.02, 200), rng.uniform(-40, 20, 200)])
    lon = np.concatenate([rng.uniform(-5, 25, 400), 10 + rng.normal(0, 0.02, 200), rng.uniform(-100, -40, 200)])
    assert {g for _, g in check(spark, rings, lat, lon)} == {1, 2, 3}


def test_crossing_edges_of_all_lengths(spark):
    """Random rings cross themselves; their edges span many cells, and are level or upright."""
    rng = np.random.default_rng(6)
    rings = {1: list(zip(rng.uniform(-3, 3, 60), rng.uniform(-3, 3, 60))), 2: list(zip(rng.integers(-4, 5, 80) * 0.1, rng.integers(-4, 5, 80) * 0.1)),
             3: list(zip(rng.integers(-9, 9, 50), rng.integers(-2, 2, 50))), 4: [(0.0, 0.0), (5.0, 1e-13), (5.0, 0.4), (0.0, 0.4)]}
    grid = np.round(np.arange(-40, 41, 5) * 0.1, 10)
    lat = np.concatenate([rng.uniform(-4, 4, 300), np.repeat(grid, len(grid)), [v[1] for v in rings[2]], rng.integers(-3, 3, 40)])
    lon = np.concatenate([rng.uniform(-9, 9, 300), np.tile(grid, len(grid)), [v[0] for v in rings[2]], rng.integers(-9, 9, 40)])
    assert {g for _, g in check(spark, rings, lat, lon)} == {1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(3))
def test_vertices_on_cell_boundaries(spark, seed):
    rng = np.random.default_rng(seed)
    s = polygons.SIZES[5 - seed]
    rings = {g: [(x * s, y * s) for x, y in rng.integers(-6, 7, (40, 2))] for g in range(4)}
    at = rng.integers(-14, 15, (300, 2)) * s / 2
    check(spark, rings, at[:, 1], at[:, 0])


def test_odd_rows(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    closed = square + square[:1]
    nan = float("nan")
    rows = [(1, closed), (1, closed), (2, square), (3, None), (4, []), (5, [(0.0, 0.0)]), (6, [(0.0, 0.0), None, (1.0, 0.0), (nan, 0.5), (1.0, 1.0), (0.0, None), (0.0, 1.0)]),
            (7, [(0.2, 0.2)] * 4), (None, closed), (8, [(a + 5.0, b) for a, b in closed]), (8, closed)]
    shapes = spark.createDataFrame(rows, RING).withColumns({"lat": F.lit("x"), "part": F.lit(0), "level": F.lit(None).cast("int")})
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, None, 0.5), (3, nan, 0.5), (4, 7.0, 7.0), (None, 0.25, 0.5), (5, 0.5, 5.5)], POINT)
    met = [1, 2, 6, 8, None]
    for short in (0, 64):
        got = polygons.containing(points.withColumn("gid", F.lit("clash")), shapes, "pid", "gid", short).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((p, g)) for p, gs in [(1, met), (1, met), (None, met), (5, [8])] for g in gs)
    for a, b in ((points.limit(0), shapes), (points, shapes.limit(0))):
        assert polygons.containing(a, b, "pid", "gid").count() == 0


def test_no_row_holds_a_long_ring(spark):
    """A ring of 100 000 edges: rows of the index hold a small part of it, and lie in many cells. Its edges are longer than a cell."""
    ring = wavy(100_000, 10.0, 45.0, 8.0, np.random.default_rng(7))
    x, y = np.array(ring).T
    shapes = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>").select(
        F.lit(1).alias("gid"), F.arrays_zip(F.col("x").alias("lon"), F.col("y").alias("lat")).alias("ring"))
    sizes = polygons.index(polygons.distinct_rings(shapes, "gid")).agg(F.max(F.size("edges")).alias("most"), F.sum(F.size("edges")).alias("all"), F.count(F.lit(1)).alias("rows"),
                                              F.countDistinct("band").alias("bands")).first()
    assert sizes["most"] <= polygons.BLOCK_EDGES and sizes["all"] < 4 * len(ring) and sizes["rows"] < 2 * len(ring) and sizes["bands"] > 50


def test_no_side_is_broadcast_and_one_hit_is_enough(spark):
    """Rows dealt to cells are no small table, whatever the size of their file."""
    rng = np.random.default_rng(8)
    rings = {g: [(x, y), (x + 2, y), (x + 2, y + 1), (x, y + 2)] for g, (x, y) in enumerate(rng.uniform(-3, 3, (30, 2)))} | {99: wavy(300, 0.0, 0.0, 4.0, rng)}
    shapes = spark.createDataFrame([(g, [tuple(map(float, v)) for v in ring]) for g, ring in rings.items()], RING)
    lat, lon = np.repeat(rng.uniform(-6, 6, 200), 2), np.repeat(rng.uniform(-6, 6, 200), 2)
    lat[:100] = rng.uniform(-6, 6, 100)   # some coordinates once, some twice
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], POINT)
    pairs, land = polygons.containing(points, shapes, "pid", "gid"), polygons.covered(points, shapes, "gid")
    want = {(int(i), g) for g, ring in rings.items() for i in np.flatnonzero(inside(ring, lat, lon))}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(r["pid"] for r in land.collect()) == sorted({i for i, _ in want})
    few = shapes.filter("gid < 99")
    for df in (polygons.containing(points, few, "pid", "gid"), polygons.covered(points, few, "gid")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_short_rings_meet_points_in_groups(spark, monkeypatch):
    """Rings of 0 to 64 edges of very different sizes, repeated points, text ids, cells in blocks: pairs are no rows of a join."""
    rng = np.random.default_rng(8)
    rings = {f"r{g}": wavy(int(rng.integers(1, 60)), *rng.uniform(-3, 3, 2), float(rng.choice([0.01, 0.3, 2.0, 40.0])), rng) for g in range(90)}
    lat, lon = np.round(rng.uniform(-4, 4, (2, 700)), 1)
    shapes = spark.createDataFrame([(g, [tuple(map(float, v)) for v in ring]) for g, ring in rings.items()], RING.replace("gid bigint", "gid string"))
    points = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], POINT.replace("pid bigint", "pid string"))
    want = sorted((f"p{i}", g) for g, ring in rings.items() for i in np.flatnonzero(inside(ring, lat, lon)))
    assert sorted(map(tuple, polygons.containing(points, shapes, "pid", "gid").collect())) == want and len(want) > 1000
    monkeypatch.setattr(polygons, "BLOCK_RINGS", 3)
    monkeypatch.setattr(polygons, "BLOCK_POINTS", 5)
    assert sorted(map(tuple, polygons.containing(points, shapes, "pid", "gid").collect())) == want
    monkeypatch.undo()
    apart = points.dropDuplicates(["lat", "lon"])
    assert "Join" not in polygons.containing(apart, shapes, "pid", "gid")._jdf.queryExecution().optimizedPlan().toString()
    assert polygons.containing(apart.limit(0), shapes, "pid", "gid").count() == polygons.containing(apart, shapes.limit(0), "pid", "gid").count() == 0
