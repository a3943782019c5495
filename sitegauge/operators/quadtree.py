"""Point cells that are split only where they are crowded.

The tree starts from cells of a fixed size. A cell with more than ``leaf_points`` distinct points is split four by four, and only the points of
split cells are looked at again, so one dense spot costs nothing elsewhere and there is no greatest depth: splitting ends when cells are
not crowded, or at ``RESOLUTION``. Searches descend cell by cell. A site that has only leaves left leaves the descent at once.

Building a tree runs jobs, one or two for each level, as the levels follow from the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import EARTH_RADIUS_KM, degree_distance, haversine_km
from sitegauge.operators.ranking import lookup
from sitegauge.session import durable

SPLIT_BITS = 2            # one level down halves a cell's sides twice
LEAF_POINTS = 64
RESOLUTION = 1e-11        # degrees; a double at 180 tells no finer cells apart
SLACK = 1.0 + 1e-9        # keeps pruning safe against rounding
LOOKUP_ROWS = 500_000     # short rows of numbers: some 30 MB


@dataclass(frozen=True)
class Metric:
    """Distance between two points and the reach of one degree."""

    wraps: bool

    def distance(self, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        return (haversine_km if self.wraps else degree_distance)(lat1, lon1, lat2, lon2)

    def at_least(self, lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, cell: float) -> Column:
        """No point of the cell is nearer than this.

        On the sphere a gap in latitude is itself a lower bound, and so is the
        distance to the nearest meridian of the cell.
        """
        dlat = F.greatest(F.lit(0.0), F.abs(lat - centre_lat) - cell / 2)
        apart = F.abs(lon - centre_lon)
        if not self.wraps:
            dlon = F.greatest(F.lit(0.0), apart - cell / 2)
            return F.sqrt(dlat * dlat + dlon * dlon) / SLACK
        around = F.least(apart, 360.0 - apart)
        dlon = F.least(F.lit(90.0), F.greatest(F.lit(0.0), around - cell / 2))
        to_meridian = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(dlon)))
        return F.greatest(F.radians(dlat), to_meridian) * F.lit(EARTH_RADIUS_KM / SLACK)


DEGREES = Metric(wraps=False)
KILOMETRES = Metric(wraps=True)


def index(value: Column, offset: float, cell: float) -> Column:
    return F.floor((value + F.lit(offset)) / F.lit(cell)).cast("bigint")


def coarser(place: Column, levels: int = 1) -> Column:
    return F.shiftright(place, SPLIT_BITS * levels)


def centre(place: Column, offset: float, cell: float) -> Column:
    return (place + 0.5) * F.lit(cell) - F.lit(offset)


@dataclass(frozen=True)
class Quadtree:
    """``cells[k]``: non-empty cells of level k (ky, kx, parent_y, parent_x, weight, mlat, mlon, leaf), below level 0 only those of split cells.

    ``points``: (level, ky, kx, plat, plon, pid, pweight), every distinct coordinate in its leaf.
    """

    points: DataFrame
    cells: list[DataFrame]
    cell: float

    def size(self, level: int) -> float:
        return self.cell / (1 << (SPLIT_BITS * level))


def distinct_points(points: DataFrame, point_id: str) -> DataFrame:
    """One row per coordinate: smallest id and the number of copies."""
    return points.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(
        F.min(point_id).alias("pid"), F.count(F.lit(1)).alias("pweight"))


def build(points: DataFrame, point_id: str, cell: float, leaf_points: int = LEAF_POINTS) -> Quadtree:
    """Tree over the distinct coordinates of ``points`` (lat, lon, ``point_id``)."""
    def keyed(rows: DataFrame, size: float) -> DataFrame:
        return rows.select("plat", "plon", "pid", "pweight", index(F.col("plat"), 90.0, size).alias("ky"), index(F.col("plon"), 180.0, size).alias("kx"))
    open_ = keyed(distinct_points(points, point_id), cell)
    cells, leaves = [], []
    while True:
        level = len(cells)
        size = cell / (1 << (SPLIT_BITS * level))
        crowd = F.lit(size > RESOLUTION) & (F.col("n") > leaf_points)
        counted = open_.groupBy("ky", "kx").agg(F.count(F.lit(1)).alias("n"), F.sum("pweight").alias("weight"), F.min(F.struct("plat", "plon")).alias("member"))
        cells.append(durable(counted.select("ky", "kx", coarser(F.col("ky")).alias("parent_y"), coarser(F.col("kx")).alias("parent_x"), "weight",
                                            F.col("member.plat").alias("mlat"), F.col("member.plon").alias("mlon"), (~crowd).alias("leaf"))))
        split = cells[-1].filter("NOT leaf").select("ky", "kx")
        if split.isEmpty():
            leaves.append(open_.withColumn("level", F.lit(level)))
            break
        split = lookup(split)
        leaves.append(open_.join(split, ["ky", "kx"], "left_anti").withColumn("level", F.lit(level)))
        # Only the points of split cells go on.
        open_ = durable(keyed(open_.join(split, ["ky", "kx"], "left_semi"), cell / (1 << (SPLIT_BITS * (level + 1)))))
    return Quadtree(reduce(DataFrame.unionByName, leaves).select("level", "ky", "kx", "plat", "plon", "pid", "pweight"), cells, cell)


def _children(tree: Quadtree, level: int) -> DataFrame:
    """Cells of a level under names of their own."""
    return lookup(tree.cells[level].select(F.col("parent_y").alias("py"), F.col("parent_x").alias("px"), F.col("ky").alias("ny"), F.col("kx").alias("nx"),
                                           "weight", "mlat", "mlon", "leaf"), LOOKUP_ROWS)


def _reached(frontier: DataFrame, tree: Quadtree, level: int) -> DataFrame:
    """Cells of a level below the frontier's (at level 0: the frontier's own)."""
    cells = _children(tree, level)
    same = (F.col("ky") == F.col("py")) & (F.col("kx") == F.col("px")) if level else (F.col("ky") == F.col("ny")) & (F.col("kx") == F.col("nx"))
    return frontier.join(cells, same)


def _leaf_pairs(targets: DataFrame, tree: Quadtree) -> DataFrame:
    points = lookup(tree.points.withColumnsRenamed({"level": "plevel", "ky": "cy", "kx": "cx"}), LOOKUP_ROWS)
    return targets.repartition("sid", "level", "ky", "kx").join(points, (F.col("level") == F.col("plevel")) & (F.col("ky") == F.col("cy")) & (F.col("kx") == F.col("cx")))


def nearest(frontier: DataFrame, tree: Quadtree, metric: Metric, radius: float | None = None, inclusive: bool = True) -> DataFrame:
    """(sid, hit = (distance, pid)) for sites (sid, slat, slon, ky, kx) exploded to the level-0 cells where their nearest point may be.

    At every level only cells that may be nearer than the best member of any go on.
    """
    targets, last = [], len(tree.cells) - 1
    frontier, carried = frontier.repartition("sid", "ky", "kx"), None
    for level in range(last + 1):
        size = tree.size(level)
        reached = _reached(frontier, tree, level)
        measured = reached.select(
            "sid", "slat", "slon", metric.distance(F.col("slat"), F.col("slon"), F.col("mlat"), F.col("mlon")).alias("near"),
            metric.at_least(F.col("slat"), F.col("slon"), centre(F.col("ny"), 90.0, size), centre(F.col("nx"), 180.0, size), size).alias("at_least"),
            F.lit(level).alias("level"), F.col("ny").alias("ky"), F.col("nx").alias("kx"), "leaf")
        measured = measured if carried is None else measured.unionByName(carried)
        if radius is not None:
            measured = measured.filter(F.col("at_least") <= radius * SLACK)
        # A site has a bounded number of live cells, so its list stays short.
        lists = measured.groupBy("sid", "slat", "slon").agg(
            F.min("near").alias("best"), F.collect_list(F.struct("near", "at_least", "level", "ky", "kx", "leaf")).alias("cells")).select(
                "sid", "slat", "slon", F.filter("cells", lambda c: c["at_least"] <= F.col("best") * SLACK).alias("cells"))
        inner = F.exists("cells", lambda c: ~c["leaf"])
        if level < last:
            lists = durable(lists)
        settled = lists if level == last else lists.filter(~inner)
        targets.append(settled.select("sid", "slat", "slon", F.explode("cells").alias("c")).select("sid", "slat", "slon", "c.level", "c.ky", "c.kx"))
        if level < last:
            open_ = lists.filter(inner).select("sid", "slat", "slon", F.explode("cells").alias("c")).select("sid", "slat", "slon", "c.*")
            frontier, carried = open_.filter("NOT leaf").select("sid", "slat", "slon", "ky", "kx"), open_.filter("leaf")
    pairs = _leaf_pairs(reduce(DataFrame.unionByName, targets), tree)
    found = pairs.select("sid", metric.distance(F.col("slat"), F.col("slon"), F.col("plat"), F.col("plon")).alias("distance"), "pid")
    if radius is not None:
        found = found.filter((F.col("distance") <= radius) if inclusive else (F.col("distance") < radius))
    return found.groupBy("sid").agg(F.min(F.struct("distance", "pid")).alias("hit"))
