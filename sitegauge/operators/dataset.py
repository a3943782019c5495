"""Merging, deduplication, sampling and splits of location tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scalar import (
    cell_key, cell_round, cell_trunc, hash_order, hash_uniform, is_land_rough, is_land_sampled,
    region_boxes, region_rules, region_rules_negative)
from sitegauge.operators.ranking import exact_rank, first_in_order, hash_cuts, keep_first, lookup, top_n
from sitegauge.operators.spatial import cells_near, exclude_same_cell, outside_cells
from sitegauge.session import durable

LOCATION_COLUMNS = ("lat", "lon", "energy_type", "source", "name", "capacity_mw", "country_code", "operating_year")
SNAP_DEG = 0.005

# Fixed values: (positives, negatives) wanted per energy type.
TARGETS = {"solar": (5000, 5000), "wind": (5000, 5000), "hydro": (2000, 2000), "geothermal": (500, 500)}
TARGETS_POLYGONS = {"solar": (5000, 5000), "wind": (3000, 3000)}


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Union of sources on the common columns; later frames rank behind earlier ones."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    for column in LOCATION_COLUMNS:
        if column not in merged.columns:
            merged = merged.withColumn(column, F.lit(0.0) if column == "capacity_mw" else F.lit(""))
    text = {c: "" for c in ("source", "name", "country_code", "operating_year")}
    return merged.fillna({**text, "capacity_mw": 0.0})


def dedup_grid(df: DataFrame, order: Sequence[str] = ("source_rank", "loc_id"), step: float = SNAP_DEG) -> DataFrame:
    """First row per 0.005 degree cell and energy type."""
    keyed = df.withColumns({"_y": cell_round(F.col("lat"), step), "_x": cell_round(F.col("lon"), step)})
    return keep_first(keyed, ["_y", "_x", "energy_type"], order).drop("_y", "_x")


def dedup_exact(df: DataFrame, order: Sequence[str] = ("source_rank", "loc_id")) -> DataFrame:
    """First row per coordinate and energy type."""
    return keep_first(df, ["lat", "lon", "energy_type"], order)


def sample_per_group(df: DataFrame, group: Sequence[str], k: int | Column, key: str, seed: object = 42) -> DataFrame:
    """At most k rows per group in reproducible random order."""
    u = hash_order(F.col(key), seed)
    return top_n(df.withColumn("_u", u), group, ["_u", key], k).drop("_u")


def sample_positives(df: DataFrame, targets: Mapping[str, int], key: str, cells: str = "round",
                     seed: object = 42) -> DataFrame:
    """Geographically spread positives per energy type.

    Each 1-degree cell first offers a quota of rows; if that gives too few the
    sample is topped up from the rest, if too many it is thinned. Both steps are
    one order: quota rows before the rest, random within. ``cells`` picks the
    cell rule: ``round`` with three times the even share (rounded up), or
    ``trunc`` with the even share (rounded down).
    """
    cell = {"round": cell_round, "trunc": cell_trunc}[cells]
    wanted = F.create_map(*[F.lit(x) for t, n in targets.items() for x in (t, n)])
    pool = df.filter(F.col("energy_type").isin(*targets)).withColumns({
        "_cell": cell_key(cell(F.col("lat")), cell(F.col("lon"))), "_u": hash_order(F.col(key), seed)})
    per_cell = pool.groupBy("energy_type", "_cell").agg(F.count(F.lit(1)).alias("n"))
    # One row per energy type: at most as many as there are targets.
    stats = per_cell.groupBy("energy_type").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"))
    goal = F.least(wanted[F.col("energy_type")], F.col("n_rows"))
    share = goal / F.col("n_cells")
    quota = F.ceil(share * 3) if cells == "round" else F.floor(share)
    stats = stats.select("energy_type", F.greatest(F.lit(1), quota).alias("_quota"), goal.alias("_goal"))
    slim = pool.select(key, "energy_type", "_cell", "_u")
    ranked = exact_rank(slim, ["energy_type", "_cell"], ["_u", key], "_place").join(F.broadcast(stats), "energy_type")
    late = F.when(F.col("_place") <= F.col("_quota"), F.lit(0)).otherwise(F.lit(1))
    # Late rows rank behind all others: the hash has 32 bits.
    chosen = first_in_order(ranked, "energy_type", F.shiftleft(late.cast("bigint"), 32) + F.col("_u"), key, F.col("_goal"), 16)
    return df.join(chosen.select(key), key, "left_semi")


def candidate_points(spark: SparkSession, first: int, end: int, seed: object, equal_area: bool) -> DataFrame:
    """Reproducible random points (candidate, lat, lon, u) with numbers from ``first`` below ``end``, spread over the executors."""
    ids = spark.range(first, end).withColumnRenamed("id", "candidate")
    ulat, ulon, u = (hash_uniform(F.col("candidate"), f"{seed}:{axis}") for axis in ("lat", "lon", "keep"))
    if equal_area:
        lat, lon = F.degrees(F.asin(2.0 * ulat - 1.0)), -180.0 + 360.0 * ulon
    else:
        lat, lon = -55.0 + 125.0 * ulat, -170.0 + 350.0 * ulon
    # Six decimals (about 0.1 m) make the points identical on every platform.
    return ids.select("candidate", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), u.alias("u"))


MAX_BATCHES = 200
DRAWS = 2


def negatives_by_type(occupied: DataFrame, wanted: Mapping[str, int], seed: object = 42, style: str = "spaced",
                      draws: int = DRAWS, max_batches: int = MAX_BATCHES) -> DataFrame:
    """The first acceptable candidates of every energy type: (energy_type, candidate, lat, lon).

    ``spaced`` keeps clear of the 3x3 cells around positives of the same type and
    uses the coarse land rule; ``sampled`` keeps out of cells occupied by any type
    and thins the far north. A batch draws ``draws`` candidates per wanted row;
    candidates rejected for water or for a neighbour count as drawn. Types that
    are short get further batches, twice as many each time. If ``max_batches``
    batches do not do, there is no room for as many rows, which is an error. The
    result does not depend on the size of the batches. All types share one
    exclusion join; what a batch accepted is kept, so no candidate is drawn twice.
    Runs jobs while the plan is built, as the number of batches follows from the data.
    """
    spark = occupied.sparkSession
    spaced = style == "spaced"
    lat, lon = F.col("lat"), F.col("lon")
    goal = F.create_map(*[F.lit(x) for t, n in wanted.items() for x in (t, n)])[F.col("energy_type")]
    blocked = durable(cells_near(occupied, by=["energy_type"])) if spaced else durable(occupied.select("lat", "lon").distinct())

    def accepted(ranges: Mapping[str, tuple[int, int]]) -> DataFrame:
        pool = reduce(DataFrame.unionByName, [
            candidate_points(spark, first, end, f"{seed}:{t}", equal_area=spaced).withColumn("energy_type", F.lit(t))
            for t, (first, end) in ranges.items()])
        if spaced:
            free = outside_cells(pool.filter((lat > -56) & (lat < 72) & is_land_rough(lat, lon)), blocked, by=["energy_type"])
        else:
            free = exclude_same_cell(pool.filter(is_land_sampled(lat, lon, F.col("u"))), blocked)
        return free.select("energy_type", "candidate", "lat", "lon")

    done, batches, counts, kept = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 1), dict.fromkeys(wanted, 0), []
    open_ = sorted(wanted)
    while open_:
        size = {t: wanted[t] * draws for t in open_}
        kept.append(durable(accepted({t: (size[t] * done[t], size[t] * batches[t]) for t in open_})))
        for t, n in kept[-1].groupBy("energy_type").count().collect():   # one row per energy type
            counts[t] += n
        for t in open_:
            done[t] = batches[t]
        open_ = [t for t in open_ if counts[t] < wanted[t]]
        for t in open_:
            if done[t] >= max_batches:
                raise ValueError(f"only {counts[t]} of {wanted[t]} negatives for {t} after {max_batches} batches")
            batches[t] = min(max_batches, 2 * done[t])
    return first_in_order(reduce(DataFrame.unionByName, kept), "energy_type", F.col("candidate"), "candidate", goal, 12)


def build_dataset(locations: DataFrame, targets: Mapping[str, tuple[int, int]], key: str,
                  seed: object = 42, style: str = "sampled") -> DataFrame:
    """Balanced labelled samples of every energy type, in random order of ``shuffle_key``."""
    cells = "trunc" if style == "sampled" else "round"
    positive_region = region_rules if style == "sampled" else region_boxes
    negative_region = region_rules_negative if style == "sampled" else region_boxes
    positives = sample_positives(locations, {t: p for t, (p, _) in targets.items()}, key, cells, seed)
    labelled = positives.select(
        F.concat(F.lit("p"), F.col(key).cast("string")).alias("sample_id"), "lat", "lon", "energy_type",
        F.lit(1).alias("label"), "source", "country_code", positive_region(F.col("lat"), F.col("lon")).alias("region"),
        "operating_year", "capacity_mw")
    wanted = {t: n for t, (_, n) in targets.items()}
    negatives = negatives_by_type(locations, wanted, seed, style)
    unlabelled = negatives.select(
        F.concat(F.lit("n"), "energy_type", F.col("candidate").cast("string")).alias("sample_id"), "lat", "lon",
        "energy_type", F.lit(0).alias("label"), F.lit("negative_sample").alias("source"), F.lit("").alias("country_code"),
        negative_region(F.col("lat"), F.col("lon")).alias("region"), F.lit("").alias("operating_year"),
        F.lit(0.0).alias("capacity_mw"))
    # An energy type without any location is left out altogether, negatives included.
    present = locations.select("energy_type").distinct()
    every = labelled.unionByName(unlabelled).join(F.broadcast(present.filter(
        F.col("energy_type").isin(*targets))), "energy_type", "left_semi")
    return every.withColumn("shuffle_key", hash_order(F.col("sample_id"), seed))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: object = 42) -> DataFrame:
    """Add ``is_test``: exactly round(fraction x size) rows of every label.

    Only the hash order of the keys is examined; the rows themselves, however
    wide, are compared with one cut per label and not shuffled.
    """
    ordered = df.withColumn("_u", hash_order(F.col(key), seed))
    take = F.bround(F.col("n") * F.lit(fraction), 0).cast("bigint")
    cuts = hash_cuts(ordered, label, "_u", key, F.array(take))
    joined = ordered.join(lookup(cuts), label, "left")   # one row per label
    last = F.col("cut")[0]
    is_test = F.coalesce(F.struct(F.col("_u"), F.col(key).alias("_k")) <= last, F.lit(False))
    return joined.select(*df.columns, is_test.alias("is_test"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: object = 42) -> DataFrame:
    """Add ``fold`` in [0, k): consecutive parts of the hash order, even within every label."""
    ordered = df.withColumn("_u", hash_order(F.col(key), seed))
    n = F.col("n")
    # The first n mod k folds get one row more.
    ends = F.transform(F.array(*[F.lit(i).cast("bigint") for i in range(1, k)]),
                       lambda i: i * F.floor(n / k) + F.least(i, n % k))
    cuts = hash_cuts(ordered, label, "_u", key, F.array_distinct(ends))
    joined = ordered.join(lookup(cuts), label, "left")   # one row per label
    here = F.struct(F.col("_u"), F.col(key).alias("_k"))
    fold = F.coalesce(F.size(F.filter("cut", lambda c: c < here)), F.lit(0))
    return joined.select(*df.columns, fold.alias("fold"))
