"""Summary counts, data-quality checks and hold-out bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import ENERGY_TYPES, year4
from sitegauge.operators.spatial import nearest_feature


def summary(df: DataFrame, dimensions: Sequence[str] = ("energy_type", "region", "source", "country_code")) -> DataFrame:
    """Counts per value of several columns in one pass: (dimension, value, n)."""
    grouped = df.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def top_values(counts: DataFrame, dimension: str, n: int = 15) -> DataFrame:
    return counts.filter(F.col("dimension") == dimension).orderBy(F.col("n").desc(), "value").limit(n)


def count_by_label(df: DataFrame) -> DataFrame:
    return df.groupBy("energy_type", "label").agg(F.count(F.lit(1)).alias("n"))


def region_mix(df: DataFrame) -> DataFrame:
    """Regions of the positives per energy type."""
    return df.filter(F.col("label") == 1).groupBy("energy_type", "region").agg(F.count(F.lit(1)).alias("n"))


def spatial_separation(df: DataFrame) -> DataFrame:
    """Mean position of positives and negatives per type and the distance between them."""
    def mean(column: str, label: int) -> Column:
        return F.avg(F.when(F.col("label") == label, F.col(column)))
    means = df.groupBy("energy_type").agg(
        mean("lat", 1).alias("pos_lat"), mean("lon", 1).alias("pos_lon"),
        mean("lat", 0).alias("neg_lat"), mean("lon", 0).alias("neg_lon"))
    both = means.filter(F.col("pos_lat").isNotNull() & F.col("neg_lat").isNotNull())
    return both.withColumn("distance_deg", F.hypot(F.col("pos_lat") - F.col("neg_lat"), F.col("pos_lon") - F.col("neg_lon")))


def time_split(df: DataFrame, year: int = 2020) -> DataFrame:
    """First and last year and the counts before and from ``year``, per energy type."""
    y = F.col("_y")
    return df.withColumn("_y", year4(F.col("operating_year"))).filter(y.isNotNull()).groupBy("energy_type").agg(
        F.min(y).alias("min_year"), F.max(y).alias("max_year"),
        F.sum((y < year).cast("bigint")).alias("n_before"), F.sum((y >= year).cast("bigint")).alias("n_after"))


def data_quality(df: DataFrame) -> DataFrame:
    """Fifteen checks as rows (check, passed).

    Everything is counted per (coordinate, type) first. Copies collapse on the
    map side, and the final step sees one short line per place.
    """
    def rows_with(condition: Column) -> Column:
        return F.sum(F.when(condition, F.lit(1)).otherwise(0))

    label = F.col("label")
    places = df.groupBy("lat", "lon", "energy_type").agg(
        F.count(F.lit(1)).alias("n"), rows_with(label.isNull()).alias("null_label"),
        rows_with(~label.isin(0, 1)).alias("bad_label"),
        rows_with(label == 1).alias("pos"), rows_with(label == 0).alias("neg"),
        F.min(F.when(label == 1, F.col("region"))).alias("first_region"),
        F.max(F.when(label == 1, F.col("region"))).alias("last_region"))
    n = F.col("n")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    lat_ok, lon_ok = F.col("lat").between(-90, 90), F.col("lon").between(-180, 180)
    aggregates = [
        (rows_where(F.col("lat").isNull()) == 0).alias("no_nan_lat"),
        (rows_where(F.col("lon").isNull()) == 0).alias("no_nan_lon"),
        (rows_where(F.col("energy_type").isNull()) == 0).alias("no_nan_energy_type"),
        (F.coalesce(F.sum("null_label"), F.lit(0)) == 0).alias("no_nan_label"),
        ((F.coalesce(F.sum("bad_label"), F.lit(0)) == 0) & (F.coalesce(F.sum("null_label"), F.lit(0)) == 0)).alias("valid_labels"),
        (rows_where(~F.coalesce(lat_ok & lon_ok, F.lit(False))) == 0).alias("valid_coords"),
        (F.coalesce(F.sum(n - 1), F.lit(0)) == 0).alias("no_duplicates"),
    ]
    for t in ENERGY_TYPES:
        mine = F.col("energy_type") == t
        pos, neg = F.sum(F.when(mine, F.col("pos"))), F.sum(F.when(mine, F.col("neg")))
        # A type without negatives has an infinite ratio.
        ratio_ok = F.when(neg > 0, (pos / neg > 0.3) & (pos / neg < 3.0)).when(neg == 0, F.lit(False))
        aggregates.append(ratio_ok.alias(f"balance_{t}"))
        # At least two regions: the first and the last by name differ.
        diverse = F.min(F.when(mine, F.col("first_region"))) != F.max(F.when(mine, F.col("last_region")))
        aggregates.append(F.when(F.max(mine.cast("int")) == 1, F.coalesce(diverse, F.lit(False))).alias(f"geo_diversity_{t}"))
    wide = places.agg(*aggregates)
    checks = wide.unpivot([], [F.col(c) for c in wide.columns], "check", "passed")
    # Types that do not occur are not checked.
    return checks.filter(F.col("passed").isNotNull())


def pass_rate(checks: DataFrame) -> DataFrame:
    return checks.agg(F.sum(F.col("passed").cast("bigint")).alias("n_pass"), F.count(F.lit(1)).alias("n_total"))


def embedding_quality(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """NaN rows, constant rows and dimensions that vary, as one line."""
    v = F.col(vector)
    rows = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.exists(v, lambda x: F.isnan(x)).cast("bigint")), F.lit(0)).alias("nan_rows"),
        F.coalesce(F.sum((F.array_min(v) == F.array_max(v)).cast("bigint")), F.lit(0)).alias("degenerate_rows"))
    dims = df.select(F.posexplode(v).alias("dim", "x")).groupBy("dim").agg(
        F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    active = dims.agg(F.count(F.lit(1)).alias("n_dims"), F.sum((F.col("sd") > 0.001).cast("bigint")).alias("active_dims"))
    one = F.lit(1)
    return rows.withColumn("_one", one).join(active.withColumn("_one", one), "_one").drop("_one")


def eligible_groups(df: DataFrame, group: str, min_each: int = 5, label: str = "label") -> DataFrame:
    """Groups with enough positives and negatives for a leave-one-group-out fold."""
    counts = df.groupBy(group).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("n_pos"),
                                   F.sum((F.col(label) == 0).cast("bigint")).alias("n_neg"))
    return counts.filter((F.col("n_pos") >= min_each) & (F.col("n_neg") >= min_each))


def temporal_holdout(df: DataFrame, key: str, year: int = 2020, far_km: float = 200.0) -> DataFrame:
    """Rows from ``year`` on, with their distance to the nearest earlier row.

    ``independent`` marks rows farther than ``far_km`` from all earlier ones.
    """
    dated = df.withColumn("built", year4(F.col("operating_year")))
    train, test = dated.filter(F.col("built") < year), dated.filter(F.col("built") >= year)
    near = nearest_feature(test, train, key, key).withColumnRenamed("distance", "train_km").drop("nearest_id")
    return test.join(near, key, "left").withColumn(
        "independent", F.coalesce(F.col("train_km") > far_km, F.lit(True)))
