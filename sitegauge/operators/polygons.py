"""Points in polygons: even-odd tests against rings of any length.

Rings of few edges are tested whole, in the few cells that their box covers: points and rings meet there in groups, in numpy. All others go by edges: every ring has a grid of
its own, fine enough for about one cell to an edge. A point meets only the edges that pass through its cell. What lies to the right of the cell counts at once:

* Within a band (a row of cells) each edge has a leftmost column, ``first``. For a cell left of it the edge lies wholly to the
  right, so a point sees it exactly when one end is above the point and the other is not. An end in a higher band is always above,
  one in a lower band never.
* Ends in higher bands hold for the whole cell: their number, summed from the right, is the parity of the cell.
* An end inside the band counts for the columns where just one of its two edges lies to the right; elsewhere it cancels out. These
  columns are among the cells that the edges pass through.

All comparisons are those of the plain test over all edges, so the results are equal to the last bit. Edges are rows and
meet by cell: a ring of many edges is spread over many tasks, and no ring is copied to a cell or to a point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitegauge.operators.meeting import PAIRS, meet, slices
from sitegauge.session import durable

SIZES = tuple(0.1 * 4.0 ** k for k in range(-5, 7))
SHORT_SIZES = SIZES[5:]
SHORT_RING = 64        # vertices of a ring that may be tested as a whole
MIN_CELLS = 9          # a ring of few edges lies in about this many cells
BLOCK_EDGES = 1024     # consecutive edges of a ring that may meet in one row of the index
REACH = 1000.0         # degrees; farther coordinates, NULL and NaN are missing
SLACK = 1e-9


def _known(x: Column) -> Column:
    return F.when(x.between(-REACH, REACH), x)


def _size(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIZES]), level + 1)


def distinct_rings(polygons: DataFrame, polygon_id: str) -> DataFrame:
    """(gid, part, ring, x0, x1, y0, y1): closed rings of known vertices, each once under its id."""
    known = F.filter(F.transform("ring", lambda p: F.struct(_known(p["lon"]).alias("x"), _known(p["lat"]).alias("y"))),
                     lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # Inside a transform, so that the vertices are read once.
    closed = F.transform(F.array(known), lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    # Rows that repeat a ring under one id would cancel each other out.
    rings = polygons.select(F.col(polygon_id).alias("gid"), F.get(closed, F.lit(0)).alias("ring")).groupBy("gid", F.xxhash64("ring").alias("part")).agg(
        F.first("ring").alias("ring")).filter(F.size("ring") > 1)
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return rings.withColumns({"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)})


def _finest(fits: Callable[[float], Column], sizes: Sequence[float]) -> Column:
    """Place of the first size that fits, or the last one."""
    return reduce(lambda rest, k: F.when(fits(sizes[k]), F.lit(k)).otherwise(rest), range(len(sizes) - 2, -1, -1), F.lit(len(sizes) - 1))


def _levels(rings: DataFrame) -> DataFrame:
    """(gid, part, ring, level): the finest level at which a ring's box has no more cells than the ring has edges."""
    def cells(s: float) -> Column:
        return (F.floor(F.col("x1") / s) - F.floor(F.col("x0") / s) + 1) * (F.floor(F.col("y1") / s) - F.floor(F.col("y0") / s) + 1)
    allowed = F.greatest(F.lit(MIN_CELLS), F.size("ring"))
    return rings.select("gid", "part", "ring", _finest(lambda s: cells(s) <= allowed, SIZES).alias("level"))


def _corners(rings: DataFrame) -> DataFrame:
    """One row per vertex q of a ring with the vertices before (p) and after (r) it."""
    ring = F.col("ring")
    n = F.size(ring)
    before, after = F.slice(ring, F.lit(1), n - 1), F.concat(F.slice(ring, F.lit(3), n - 2), F.slice(ring, 2, 1))
    threes = F.arrays_zip(before.alias("p"), F.slice(ring, F.lit(2), n - 1).alias("q"), after.alias("r"))
    rows = rings.select("gid", "part", "level", F.posexplode(threes).alias("at", "c"))
    names = [F.col(f"c.{v}.{a}").alias(f"{v}{a}") for v in "pqr" for a in "xy"]
    return rows.select("gid", "part", "level", F.floor(F.col("at") / BLOCK_EDGES).alias("block"), _size(F.col("level")).alias("s"), *names)


def _columns_in_band(px: Column, py: Column, qx: Column, qy: Column, band: Column, s: Column) -> tuple[Column, Column]:
    """First and last column of an edge's part inside a band, with room for rounding."""
    low, high, rise = F.least(px, qx), F.greatest(px, qx), F.abs(qy - py)
    room = F.when(rise > 0, SLACK + 1e-12 * (high - low) / rise).otherwise(F.lit(3 * REACH))

    def x_at(y: Column) -> Column:
        return F.when(rise > 0, px + (y - py) / (qy - py) * (qx - px)).otherwise(px)
    bottom, top = x_at(F.greatest(F.least(py, qy), band * s)), x_at(F.least(F.greatest(py, qy), (band + 1) * s))
    first = F.floor((F.greatest(low, F.least(bottom, top) - room) - SLACK) / s)
    last = F.floor((F.least(high, F.greatest(bottom, top) + room) + SLACK) / s)
    return first, last


def _edge_parts(corners: DataFrame) -> DataFrame:
    """Parts of edges by band that a point may cross: (gid, part, level, block, px, py, qx, qy, band, first, last, up).

    ``up`` is the number of its ends in higher bands. Level edges are never crossed.
    """
    px, py, qx, qy, s = (F.col(c) for c in ("px", "py", "qx", "qy", "s"))
    bands = F.sequence(F.floor(F.least(py, qy) / s), F.floor(F.greatest(py, qy) / s))
    parts = corners.filter(py != qy).select("*", F.explode(bands).alias("band"))
    first, last = _columns_in_band(px, py, qx, qy, F.col("band"), s)
    above = lambda y: (F.floor(y / s) > F.col("band")).cast("int")
    return parts.select("gid", "part", "level", "block", "px", "py", "qx", "qy", "band", first.alias("first"), last.alias("last"),
                        (above(py) + above(qy)).alias("up"))


def _ends(corners: DataFrame) -> DataFrame:
    """Vertices by cell where just one of their two edges lies to the right: (gid, part, level, block, band, column, y)."""
    s, band = F.col("s"), F.floor(F.col("qy") / F.col("s"))
    one = _columns_in_band(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"), band, s)[0]
    other = _columns_in_band(F.col("qx"), F.col("qy"), F.col("rx"), F.col("ry"), band, s)[0]
    differing = corners.select("gid", "part", "level", "block", band.alias("band"), "qy", one.alias("one"), other.alias("other")).filter("one <> other")
    columns = F.sequence(F.least("one", "other"), F.greatest("one", "other") - 1)
    return differing.select("gid", "part", "level", "block", "band", F.explode(columns).alias("column"), F.col("qy").alias("y"))


def index(rings: DataFrame) -> DataFrame:
    """Of ``distinct_rings``: (level, band, column, gid, part, edges, ends, base): a point is inside when ``base`` and its crossings add up to an odd number.

    A cell may have several rows of one ring; they add up.
    """
    corners = _corners(_levels(rings))
    parts = _edge_parts(corners)
    key = ["gid", "part", "level", "band", "column"]
    edge, end = "struct<px:double,py:double,qx:double,qy:double>", "double"
    through = parts.select(*key[:4], "block", F.explode(F.sequence("first", "last")).alias("column"), F.struct("px", "py", "qx", "qy").alias("edge"),
                           F.lit(None).cast(end).alias("y"))
    paired = _ends(corners).select(*key[:4], "block", "column", F.lit(None).cast(edge).alias("edge"), "y")
    tests = through.unionByName(paired).groupBy(*key, "block").agg(F.collect_list("edge").alias("edges"), F.collect_list("y").alias("ends")).select(
        *key, "edges", "ends", F.lit(0).alias("base"))

    # Parity of every cell from the right, and of the runs of cells between those that an edge passes through.
    cells = parts.groupBy(*key[:4], F.col("first").alias("column")).agg(F.sum("up").alias("up"))
    band = Window.partitionBy(*key[:4]).orderBy(F.col("column").desc())
    own = F.sum("up").over(band) % 2
    runs = cells.select(*key, own.alias("own"), F.lead("column").over(band).alias("left"))
    odd = runs.filter("own = 1 AND left < column").select(*key[:4], F.explode(F.sequence(F.col("left"), F.col("column") - 1)).alias("column"))
    inner = odd.select(*key, F.array().cast(f"array<{edge}>").alias("edges"), F.array().cast(f"array<{end}>").alias("ends"), F.lit(1).alias("base"))
    return tests.unionByName(inner)


def _crossed(edges: Column, lat: Column, lon: Column) -> Column:
    """Number of edges that a ray to the right meets."""
    return F.size(F.filter(edges, lambda e: ((e["py"] > lat) != (e["qy"] > lat)) & (
        lon < e["px"] + (lat - e["py"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)) * (e["qx"] - e["px"]))))


def _probes(spots: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """Cells of every point, one for each size."""
    return spots.select("plat", "plon", "pid", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("plat") / s).alias("band"), F.floor(F.col("plon") / s).alias("column"))
        for k, s in enumerate(sizes)])).alias("c")).select("plat", "plon", "pid", "c.*")


_CELL = ("level", "band", "column")


def _same_cell(probes: DataFrame, cells: DataFrame, *also: Column, how: str = "inner") -> DataFrame:
    """Points met by what their cells hold. Rows multiply when they are dealt to cells, so sizes guessed from files say nothing: sorted on both sides, never broadcast."""
    held = cells.withColumnsRenamed({c: f"c{c}" for c in _CELL}).hint("merge")
    return probes.join(held, reduce(Column.__and__, [*[F.col(c) == F.col(f"c{c}") for c in _CELL], *also]), how)


def _short_cells(rings: DataFrame) -> tuple[DataFrame, Column]:
    """Rings of few edges, whole, in at most nine cells each, with the test that a point of the cell lies inside."""
    edges = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda p, q: F.struct(
        p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    held = rings.select("gid", edges.alias("edges"), F.transform("ring", lambda p: p["x"]).alias("xs"), F.transform("ring", lambda p: p["y"]).alias("ys"),
                        "x0", "x1", "y0", "y1", _finest(lambda s: extent <= 2 * s, SHORT_SIZES).alias("level"))
    s = F.element_at(F.array(*[F.lit(v) for v in SHORT_SIZES]), F.col("level") + 1)

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / s), F.floor(F.col(high) / s)))
    cells = held.select("*", span("x0", "x1").alias("column")).select("*", span("y0", "y1").alias("band"))
    inside = (F.col("plon").between(F.col("x0"), F.col("x1")) & F.col("plat").between(F.col("y0"), F.col("y1"))
              & (_crossed(F.col("edges"), F.col("plat"), F.col("plon")) % 2 == 1))
    return cells, inside


def _in_long(spots: DataFrame, rings: DataFrame) -> DataFrame:
    adds = F.col("base") + _crossed(F.col("edges"), F.col("plat"), F.col("plon")) + F.size(F.filter("ends", lambda y: y > F.col("plat")))
    met = _same_cell(_probes(spots, SIZES), index(rings)).select("plat", "plon", "pid", "gid", "part", adds.alias("n"))
    return met.groupBy("plat", "plon", "gid", "part").agg(F.first("pid").alias("pid"), F.sum("n").alias("n")).filter("n % 2 = 1").select("plat", "plon", "pid", "gid")


def _spots(points: DataFrame, point_id: str) -> DataFrame:
    """(plat, plon, pid, rows): every known coordinate once."""
    known = points.select(_known(F.col("lat")).alias("plat"), _known(F.col("lon")).alias("plon"), F.col(point_id).alias("pid"))
    return known.dropna(subset=["plat", "plon"]).groupBy("plat", "plon").agg(F.first("pid").alias("pid"), F.count(F.lit(1)).alias("rows"))


def _by_length(polygons: DataFrame, polygon_id: str, short: int) -> tuple[DataFrame, DataFrame | None]:
    """Short rings, and long ones if there are any: one small job tells."""
    long = polygons.filter(F.size("ring") > short)
    return distinct_rings(polygons.filter(F.size("ring") <= short), polygon_id), None if long.isEmpty() else distinct_rings(long, polygon_id)


BLOCK_RINGS, BLOCK_POINTS = 8192, 16_384    # at most about so many meet in one group


def _inside(rings: pa.RecordBatch, points: pa.RecordBatch, cells: np.ndarray, point_cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pid, gid) of the points inside rings of their cell. The points of a cell lie sorted by longitude: a ring meets a slice of them."""
    x0, x1, y0, y1 = (rings.column(c).to_numpy() for c in ("x0", "x1", "y0", "y1"))
    xs, ys = (rings.column(c).flatten().to_numpy() for c in ("xs", "ys"))
    start = rings.column("xs").offsets.to_numpy()
    start = start - start[0]
    edges = np.diff(start) - 1
    lat, lon = points.column("plat").to_numpy(), points.column("plon").to_numpy()
    order = np.lexsort((lon, point_cells))
    lat, lon, pids, gids = lat[order], lon[order], points.column("pid").take(pa.array(order)), rings.column("gid")
    known, cell = np.unique(point_cells[order], return_inverse=True)
    at = np.searchsorted(known, cells)
    present = known[np.minimum(at, len(known) - 1)] == cells
    # Rank of a longitude among all; with the cell before it, one number tells the place.
    ranks, n = np.sort(lon), len(lon) + 1
    place = cell * n + np.searchsorted(ranks, lon)
    begin = np.searchsorted(place, at * n + np.searchsorted(ranks, x0))
    end = np.searchsorted(place, at * n + np.searchsorted(ranks, x1, "right"))
    for ring, point in slices(begin, np.where(present, np.maximum(end - begin, 0), 0), PAIRS):
        near = np.flatnonzero((lat[point] >= y0[ring]) & (lat[point] <= y1[ring]))
        ring, point = ring[near], point[near]
        if not len(ring):
            continue
        u, v, first, count = lon[point], lat[point], start[ring], edges[ring]
        odd, py = np.zeros(len(ring), dtype=bool), ys[first] > v
        fewest = count.min()
        for e in range(count.max()):
            # A ring that has ended stays at its last vertex.
            here, there = (first + e, first + e + 1) if e < fewest else (first + np.minimum(e, count), first + np.minimum(e + 1, count))
            qy = ys[there] > v
            over = np.flatnonzero(py != qy)
            p, q = here[over], there[over]
            odd[over] ^= u[over] < xs[p] + (v[over] - ys[p]) / (ys[q] - ys[p]) * (xs[q] - xs[p])
            py = qy
        yield pa.RecordBatch.from_arrays([pids.take(pa.array(point[odd])), gids.take(pa.array(ring[odd]))], names=["pid", "gid"])


def _in_short(spots: DataFrame, rings: DataFrame, few: bool) -> DataFrame:
    """(pid, gid) of points in rings of few edges: they meet in groups of cells, of the sizes that rings have. One small job tells which.

    ``few`` points take only the rings of their own cells along.
    """
    cells = _short_cells(rings)[0].drop("edges").withColumn("level", F.col("level").cast("int"))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())   # at most len(SHORT_SIZES)
    sizes = [(k, SHORT_SIZES[k]) for k in levels]
    probes = spots.select("plat", "plon", "pid", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("plat") / s).alias("band"), F.floor(F.col("plon") / s).alias("column"))
        for k, s in sizes])).alias("c")).select("plat", "plon", "pid", "c.*") if sizes else spots.select("plat", "plon", "pid", *[
            F.lit(0).alias(c) for c in _CELL]).limit(0)
    if few:
        cells = cells.join(probes.select(*_CELL).distinct().hint("merge"), list(_CELL), "left_semi")
    schema = StructType([StructField("pid", spots.schema["pid"].dataType), StructField("gid", rings.schema["gid"].dataType)])
    return meet(cells, probes, _CELL, _CELL, ["gid", "x0", "y0"], ["plat", "plon"], BLOCK_RINGS, BLOCK_POINTS, _inside, schema)


def containing(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, short: int = SHORT_RING) -> DataFrame:
    """(point_id, polygon_id) for every point inside a ring by the even-odd rule. Rings above ``short`` vertices use the edge index.

    Small jobs tell while the plan is built whether there are such rings, and whether coordinates repeat.

    Vertices without a known coordinate are left out, and an open ring is closed. A ring that comes again under the same id counts
    once; different rings of one id give a row each. Points with one coordinate are tested once; repeated rows keep their rows, and
    points without a known coordinate lie in no ring. A coordinate of one row carries its id, so that its pairs are never shuffled.
    """
    short_rings, long_rings = _by_length(polygons, polygon_id, short)
    short_rings, spots = durable(short_rings), durable(_spots(points, point_id))

    def pairs(some: DataFrame, few: bool) -> DataFrame:
        """(pid, gid)"""
        found = _in_short(some, short_rings, few)
        return found if long_rings is None else found.unionByName(_in_long(some, long_rings).select("pid", "gid"))
    once = pairs(spots.filter("rows = 1"), False).select(F.col("pid").alias(point_id), F.col("gid").alias(polygon_id))
    crowded = spots.filter("rows > 1").select("plat", "plon", F.struct("plat", "plon").alias("pid"))
    if crowded.isEmpty():
        return once
    again = pairs(crowded, True).select(F.col("pid.plat").alias("plat"), F.col("pid.plon").alias("plon"), "gid")
    rows = points.select(F.col(point_id), F.col("lat"), F.col("lon"))
    return once.unionByName(rows.join(again.hint("merge"), (F.col("lat") == F.col("plat")) & (F.col("lon") == F.col("plon"))).select(
        F.col(point_id), F.col("gid").alias(polygon_id)))


def covered(points: DataFrame, polygons: DataFrame, polygon_id: str, short: int = SHORT_RING) -> DataFrame:
    """Rows of ``points`` that lie in at least one ring. The search for a point ends at the first short ring that holds it, and pairs are never made;
    only points in no short ring meet the edge index."""
    short_rings, long_rings = _by_length(polygons, polygon_id, short)
    cells, inside = _short_cells(short_rings)
    spots = _spots(points.withColumn("_none", F.lit(0)), "_none")
    found = _same_cell(_probes(spots, SHORT_SIZES), cells, inside, how="left_semi").select("plat", "plon").distinct()
    if long_rings is not None:
        rest = spots.join(found.hint("merge"), ["plat", "plon"], "left_anti")
        found = found.unionByName(_in_long(rest, long_rings).select("plat", "plon").distinct())
    return points.join(found.hint("merge"), (F.col("lat") == F.col("plat")) & (F.col("lon") == F.col("plon")), "left_semi")
