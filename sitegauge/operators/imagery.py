"""Scene selection and patch preparation, in long form (one row per pixel) or with bands as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.scalar import cases
from sitegauge.operators.ranking import top_n
from sitegauge.operators.spatial import BOX
from sitegauge.session import durable

# Mean and standard deviation of each spectral band.
BAND_STATS = {
    "B01": (1651.2, 783.0), "B02": (1349.3, 631.9), "B03": (1225.7, 568.5), "B04": (1187.3, 687.8),
    "B05": (1508.4, 609.7), "B06": (2365.9, 793.8), "B07": (2734.3, 932.3), "B08": (2597.5, 929.5),
    "B8A": (2897.0, 984.6), "B09": (846.5, 566.8), "B11": (2164.0, 862.0), "B12": (1497.7, 750.6),
}

SITE_HALF_BOX_DEG = 0.02
PATCH_SIZE = 128


def _cloud() -> Column:
    return F.coalesce("cloud", F.lit(100.0))


SCENE_CELL = 0.25          # degrees; a box of about five cells a side has many of them wholly inside
SCENE_LEVELS = 6
SCENE_FACTOR = 4.0
CELL_PARTS = 4             # a crowded cell is cut down in parts first
_CELL = ("level", "cy", "cx")


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(SCENE_FACTOR), level) * SCENE_CELL


def _wanted_by_cell(scenes: DataFrame, newest: list[Column | str], max_items: int) -> DataFrame:
    """Scenes dealt to all cells where a site's lower-left corner may lie, without those that no site of the cell can want.

    A scene is not wanted when ``max_items`` newer ones of its season cover every site of the cell. So a cell keeps
    about as many scenes as its edge needs, however many there are.
    """
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = cases(*[(extent <= 6 * SCENE_CELL * SCENE_FACTOR ** k, F.lit(k)) for k in range(SCENE_LEVELS - 1)], otherwise=F.lit(SCENE_LEVELS - 1))
    size, width, slack = _cell_size(F.col("level")), 2 * SITE_HALF_BOX_DEG, 1e-9

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(low) - width - slack) / size), F.floor((F.col(high) + slack) / size)))

    def covers(place: str, low: str, high: str) -> Column:
        start = F.col(place) * size
        return (F.col(low) + slack <= start + width) & (start + size <= F.col(high) - slack)
    dealt = scenes.filter(extent.isNotNull()).withColumn("level", level).select("*", cells("xmin", "xmax").alias("cx")).select("*", cells("ymin", "ymax").alias("cy"))
    marked = dealt.withColumns({"_whole": (covers("cx", "xmin", "xmax") & covers("cy", "ymin", "ymax")).cast("int"),
                                "_part": F.pmod(F.xxhash64("scene_id"), F.lit(CELL_PARTS))})

    def wanted(rows: DataFrame, *part: str) -> DataFrame:
        before = Window.partitionBy(*_CELL, "season", *part).orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_newer", F.coalesce(F.sum("_whole").over(before), F.lit(0))).filter(F.col("_newer") < max_items)
    # What has enough newer scenes in a part of a cell has them in the cell.
    return wanted(wanted(marked, "_part")).drop("_newer", "_whole", "_part")


def search_scenes(sites: DataFrame, scenes: DataFrame, max_cloud: float = 20.0, max_items: int = 5,
                  site_id: str = "site_id") -> DataFrame:
    """Scenes over each site: box overlap, cloud limit, the newest ``max_items`` per season.

    Scenes come on fixed tiles. All scenes of one footprint cover the same sites,
    so only the newest of each footprint and season can be among the newest of a
    site; the others leave before the join. Of the rest, a cell keeps those that some
    site in it may want, so the work for a site does not grow with the number of tiles over it.

    Runs a small job while the plan is built, to see which sizes of scenes there are.
    """
    half = SITE_HALF_BOX_DEG
    newest = [F.col("acquired").desc(), "scene_id"]
    clear = scenes.filter(F.col("cloud") < max_cloud).select("scene_id", "season", "acquired", "cloud", *BOX)
    recent = top_n(clear, [*BOX, "season"], newest, max_items)
    held = durable(_wanted_by_cell(recent, newest, max_items))
    levels = sorted(r["level"] for r in held.select("level").distinct().collect())   # at most SCENE_LEVELS rows
    corner = {"sxmin": F.col("lon") - half, "symin": F.col("lat") - half, "sxmax": F.col("lon") + half, "symax": F.col("lat") + half}
    boxes = sites.select(site_id, *[c.alias(n) for n, c in corner.items()]).select("*", F.explode(F.lit(levels).cast("array<int>")).alias("level"))
    size = _cell_size(F.col("level"))
    asked = boxes.select("*", F.floor(F.col("symin") / size).alias("cy"), F.floor(F.col("sxmin") / size).alias("cx"))
    touch = ((F.col("sxmax") >= F.col("xmin")) & (F.col("sxmin") <= F.col("xmax")) & (F.col("symax") >= F.col("ymin")) & (F.col("symin") <= F.col("ymax")))
    # Both sides have many rows of few bytes, which file sizes do not tell: never broadcast.
    hits = asked.join(held.hint("merge"), list(_CELL)).filter(touch).select(*_CELL, site_id, "season", "scene_id", "acquired", "cloud")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys, site_id, "season").orderBy(*newest))
        return rows.withColumn("_place", place).filter(F.col("_place") <= max_items).drop("_place")
    # The first cut needs no shuffle: sites of a cell are together.
    return first(first(hits, *_CELL).drop(*_CELL)).select(site_id, "scene_id", "season", "acquired", "cloud")


def best_scene(found: DataFrame, by: tuple[str, ...] = ("site_id", "season")) -> DataFrame:
    """Least cloudy scene per group; an unknown cloud cover counts as fully cloudy."""
    best = F.min_by(F.struct("scene_id", "acquired", "cloud"), F.struct(_cloud(), "scene_id"))
    return found.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def season_stack(best: DataFrame, min_seasons: int = 2) -> DataFrame:
    """Scenes per site in season order.

    Geothermal sites keep their single clearest scene of the year; other sites
    need scenes in at least ``min_seasons`` seasons or they are dropped.
    """
    per_site = best.groupBy("site_id", "energy_type").agg(
        F.array_sort(F.collect_list(F.struct("season", "scene_id"))).alias("stack"),
        F.min_by(F.struct("season", "scene_id"), F.struct(_cloud(), "season", "scene_id")).alias("clearest"))
    single = F.col("energy_type") == "geothermal"
    kept = per_site.filter(single | (F.size("stack") >= min_seasons))
    return kept.select("site_id", "energy_type", F.when(single, F.array("clearest")).otherwise(F.col("stack")).alias("stack"))


def first_season(stack: DataFrame) -> DataFrame:
    """The single-scene variant of a stack: its first season."""
    return stack.withColumn("stack", F.slice("stack", 1, 1))


def normalize_bands(pixels: DataFrame) -> DataFrame:
    """Scale values so that mean +- two deviations map to [0, 1]; unknown bands give NULL."""
    def stat(i: int) -> Column:
        return cases(*[(F.col("band") == b, F.lit(s[i])) for b, s in BAND_STATS.items()])
    low, width = stat(0) - 2.0 * stat(1), 4.0 * stat(1)
    return pixels.withColumn("value", (F.col("value") - low) / width)


def crop_pad(pixels: DataFrame, size: int = PATCH_SIZE) -> DataFrame:
    """Patches of exactly ``size`` x ``size``.

    A patch that is too small in either direction is padded with zeros at the
    bottom and right (and cut at ``size``); otherwise its centre is cropped.
    Missing and NaN values become 0.
    """
    shapes = pixels.groupBy("patch_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    small = (F.col("h") < size) | (F.col("w") < size)
    origin = lambda n: F.when(small, F.lit(0)).otherwise(F.floor((F.col(n) - size) / 2))
    shifts = shapes.select("patch_id", origin("h").alias("y0"), origin("w").alias("x0"))
    moved = pixels.join(shifts, "patch_id").select(
        "patch_id", "band", (F.col("row") - F.col("y0")).cast("int").alias("row"),
        (F.col("col") - F.col("x0")).cast("int").alias("col"), "value")
    frame = F.sequence(F.lit(0), F.lit(size - 1))
    grid = (pixels.select("patch_id", "band").distinct().select("*", F.explode(frame).alias("row"))
            .select("*", F.explode(frame).alias("col")))
    return grid.join(moved, ["patch_id", "band", "row", "col"], "left").withColumn(
        "value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))


def crop_pad_tiles(tiles: DataFrame, size: int = PATCH_SIZE) -> DataFrame:
    """``crop_pad`` of bands held as arrays: (patch_id, band, h, w, values by rows) to (patch_id, band, values). No row leaves its task."""
    small = (F.col("h") < size) | (F.col("w") < size)
    origin = lambda n: F.when(small, F.lit(0)).otherwise(F.floor((F.col(n) - size) / 2).cast("int"))
    placed = tiles.withColumns({"y0": origin("h"), "x0": origin("w")})

    def value(i: Column) -> Column:
        row, col = F.col("y0") + F.floor(i / size).cast("int"), F.col("x0") + i % size
        held = F.when((row < F.col("h")) & (col < F.col("w")), F.get("values", row * F.col("w") + col))
        return F.coalesce(F.nanvl(held, F.lit(0.0)), F.lit(0.0))
    return placed.select("patch_id", "band", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), value).alias("values"))


def mean_pool(features: DataFrame) -> DataFrame:
    """Average every channel over all positions: one vector per patch."""
    means = features.groupBy("patch_id", "channel").agg(F.avg("value").alias("value"))
    # One entry per channel, so the list is as short as the vector.
    return means.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("v")).select(
        "patch_id", F.transform("v", lambda c: c["value"]).alias("vector"))
