"""Measurements per site, from the raw readings of each source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.operators.spatial import radius_count

# Climatology parameters of the landed JSON.
CLIMATOLOGY_FIELDS = ("ALLSKY_SFC_SW_DWN", "WS10M", "T2M", "PRECTOTCORR", "CLOUD_AMT")

HUB_HEIGHT_M = 80.0
MAST_HEIGHT_M = 10.0
SHEAR_EXPONENT = 0.14
STENCIL_STEP_DEG = 0.005
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
QUAKE_RADIUS_KM = 100.0
QUAKE_MIN_MAGNITUDE = 2.0
QUAKE_FROM, QUAKE_TO = "2016-01-01", "2026-01-01"

DISCHARGE_DAYS = 365


def hub_height_wind(ws10: Column) -> Column:
    """Wind at hub height from a 10 m mast by the power law."""
    return ws10 * F.pow(F.lit(HUB_HEIGHT_M / MAST_HEIGHT_M), F.lit(SHEAR_EXPONENT))


def power_features(df: DataFrame, value: str = "value") -> DataFrame:
    """Climate measurements from climatology JSON; fill values become NULL."""
    inner = ", ".join(f"{f}: struct<ANN: double>" for f in CLIMATOLOGY_FIELDS)
    parsed = df.withColumn("_p", F.from_json(value, f"properties struct<parameter: struct<{inner}>>")["properties"]["parameter"])

    def annual(name: str) -> Column:
        return F.col("_p")[name]["ANN"]

    ghi, wind, temp, cloud, rain = (annual(n) for n in ("ALLSKY_SFC_SW_DWN", "WS10M", "T2M", "CLOUD_AMT", "PRECTOTCORR"))
    return parsed.withColumns({
        "ghi_kwh_m2_day": F.when(ghi > 0, ghi),
        "wind_speed_ms": F.when(wind > 0, hub_height_wind(wind)),
        "avg_temp_c": F.when(temp > -100, temp),
        "cloud_fraction": F.when(cloud >= 0, cloud / 100.0),
        "precipitation_mm_day": F.when(rain >= 0, rain),
    }).drop("_p", value)


def terrain_features(stencil: DataFrame, site: str = "site_id") -> DataFrame:
    """Elevation, slope and head from five points per site (centre, N, S, E, W)."""
    def at(position: str) -> Column:
        return F.max(F.when(F.col("position") == position, F.col("elevation")))

    wide = stencil.groupBy(site).agg(
        at("C").alias("c"), at("N").alias("n"), at("S").alias("s"), at("E").alias("e"), at("W").alias("w"),
        F.max(F.when(F.col("position") == "C", F.col("lat"))).alias("lat"), F.count("elevation").alias("points"))
    dx = F.lit(STENCIL_STEP_DEG * METRES_PER_DEGREE_LON) * F.cos(F.radians("lat"))
    dy = F.lit(STENCIL_STEP_DEG * METRES_PER_DEGREE_LAT)
    gx, gy = (F.col("e") - F.col("w")) / (2 * dx), (F.col("n") - F.col("s")) / (2 * dy)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    five = [F.col(p) for p in "cnsew"]
    full = F.col("points") == 5
    return wide.select(site, F.when(full, F.col("c")).alias("elevation_m"), F.when(full, slope).alias("slope_degrees"),
                       F.when(full, F.greatest(*five) - F.least(*five)).alias("head_m"))


def in_trailing_days(ts: Column, as_of: Column, days: int = DISCHARGE_DAYS) -> Column:
    """True for times in the ``days`` days up to ``as_of``, which counts in."""
    return (ts > as_of - F.make_interval(days=F.lit(days))) & (ts <= as_of)


def discharge_features(readings: DataFrame, as_of: Column, site: str = "site_id", value: str = "discharge", ts: str = "ts") -> DataFrame:
    """Mean of the valid (non-negative) daily discharges per site over the year up to ``as_of``.

    Sites without a reading in that year have no row.
    """
    v = F.col(value)
    return readings.filter(in_trailing_days(F.col(ts), as_of)).groupBy(site).agg(F.avg(F.when(v >= 0, v)).alias("discharge_m3s"))


def discharge_mean(series: Column) -> Column:
    """The same mean when a site carries its year as an array."""
    valid = F.filter(series, lambda v: v.isNotNull() & (v >= 0))
    total = F.aggregate(valid, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(valid).cast("double"))


def quake_features(sites: DataFrame, quakes: DataFrame, site: str = "site_id") -> DataFrame:
    """Earthquakes of the last decade within 100 km, and their yearly density per 10 000 km2."""
    recent = quakes.filter((F.col("magnitude") >= QUAKE_MIN_MAGNITUDE)
                           & (F.col("ts") >= F.lit(QUAKE_FROM).cast("timestamp_ntz"))
                           & (F.col("ts") < F.lit(QUAKE_TO).cast("timestamp_ntz")))
    counted = radius_count(sites, recent, QUAKE_RADIUS_KM, site, "quake_id")
    area = F.pi() * F.lit(QUAKE_RADIUS_KM ** 2) / 10000.0
    return counted.select(site, F.col("n").alias("earthquake_count_10yr"),
                          (F.col("n") / area / 10.0).alias("earthquake_density"))


def direction_consistency(readings: DataFrame, site: str = "site_id") -> DataFrame:
    """Length of the mean wind vector over the mean speed; NULL without wind."""
    v, a = F.col("speed"), F.radians("direction_deg")
    sums = readings.groupBy(site).agg(
        F.avg(v * F.cos(a)).alias("x"), F.avg(v * F.sin(a)).alias("y"), F.avg(v).alias("m"))
    return sums.select(site, F.try_divide(F.hypot("x", "y"), F.col("m")).alias("direction_consistency"))


def ndvi_mean(pixels: DataFrame, site: str = "site_id") -> DataFrame:
    """Mean vegetation index per watershed; pixels without signal are left out."""
    nir, red = F.col("nir"), F.col("red")
    return pixels.groupBy(site).agg(F.avg(F.try_divide(nir - red, nir + red)).alias("watershed_ndvi"))


def assemble(sites: DataFrame, *features: DataFrame, key: str = "site_id") -> DataFrame:
    """Left-join measurement tables; a site missing from a source keeps NULL there."""
    return reduce(lambda acc, f: acc.join(f, key, "left"), features, sites)


def external_features(lat: Column, lon: Column) -> list[Column]:
    """Eight location features."""
    return [
        (F.abs(lat) / 90.0).alias("abs_lat"),
        F.cos(F.radians(lat)).alias("cos_lat"),
        (lon / 180.0).alias("lon_norm"),
        F.pow(lat / 90.0, F.lit(2.0)).alias("lat_sq"),
        F.sin(F.radians(lon)).alias("sin_lon"),
        F.cos(F.radians(lon)).alias("cos_lon"),
        (F.abs(lat - 35.0) / 90.0).alias("belt_distance"),
        F.when(F.abs(lat) > 30, F.lit(1.0)).otherwise(F.lit(0.0)).alias("high_lat"),
    ]


def geo_features(lat: Column, lon: Column) -> list[Column]:
    """Six position features of the location-only baseline."""
    return [lat.alias("lat"), lon.alias("lon"), F.abs(lat).alias("abs_lat"), F.cos(F.radians(lat)).alias("cos_lat"),
            F.sin(F.radians(lon)).alias("sin_lon"), F.cos(F.radians(lon)).alias("cos_lon")]
