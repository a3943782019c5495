"""Measurement and feature queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions.scalar import year4
from sitegauge.operators import features
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.geo_queries import hav
from sitegauge.plans.registry import query

_SHEAR = "pow(8::double, 0.14::double)"


def _climatology_json(spark, d):
    c = frame(spark, d, "climatology")
    ann = lambda name: F.struct(F.col(name).alias("ANN"))
    parameter = F.struct(ann("ghi").alias("ALLSKY_SFC_SW_DWN"), ann("ws").alias("WS10M"), ann("t2").alias("T2M"),
                         ann("pr").alias("PRECTOTCORR"), ann("cl").alias("CLOUD_AMT"))
    return c.select("site_id", F.to_json(F.struct(F.struct(parameter.alias("parameter")).alias("properties"))).alias("value"))


_POWER = (f"SELECT site_id, CASE WHEN ghi>0 THEN ghi END AS ghi_kwh_m2_day, round(CASE WHEN ws>0 THEN ws*{_SHEAR} END, 9) AS wind_speed_ms, "
          "CASE WHEN t2>-100 THEN round(t2, 6) END AS avg_temp_c, CASE WHEN cl>=0 THEN round(cl/100, 6) END AS cloud_fraction, CASE WHEN pr>=0 THEN pr END AS precipitation_mm_day FROM climatology")


def _power(spark, d):
    out = features.power_features(_climatology_json(spark, d))
    return out.withColumns({"wind_speed_ms": F.round("wind_speed_ms", 9), "avg_temp_c": F.round("avg_temp_c", 6), "cloud_fraction": F.round("cloud_fraction", 6)})


@query("nasa_power_features", cte("climatology") + " " + _POWER)
def nasa_power_features(spark, d):
    return _power(spark, d)


@query("hub_height_wind", cte("sites") + f" SELECT site_id, round(wind_speed_ms*{_SHEAR}, 9) AS v80 FROM sites")
def hub_height_wind(spark, d):
    return frame(spark, d, "sites").select("site_id", F.round(features.hub_height_wind(F.col("wind_speed_ms")), 9).alias("v80"))


def _stencil(spark, d):
    t = frame(spark, d, "terrain")
    points = F.array(*[F.struct(F.lit(p.upper()).alias("position"), F.col(p).alias("elevation")) for p in "cnsew"])
    return t.select("site_id", "lat", F.explode(points).alias("p")).select("site_id", "lat", "p.*")


_TERRAIN = ("SELECT site_id, CASE WHEN w IS NOT NULL THEN c END AS elevation_m, round(CASE WHEN w IS NOT NULL THEN degrees(atan(sqrt(pow((e-w)/(2*0.005::double*111320*cos(radians(lat))),2)+pow((n-s)/(2*0.005::double*110540),2)))) END, 6) AS slope_degrees, "
            "CASE WHEN w IS NOT NULL THEN greatest(c,n,s,e,w)-least(c,n,s,e,w) END AS head_m FROM terrain")


@query("slope_from_stencil", cte("terrain") + " " + _TERRAIN)
def slope_from_stencil(spark, d):
    return features.terrain_features(_stencil(spark, d)).withColumn("slope_degrees", F.round("slope_degrees", 6))


# The readings are of January 2024; the year up to this day leaves the first half of them out.
_AS_OF = "2025-01-16"
_YEAR_SQL = f"ts>TIMESTAMP '{_AS_OF}'-INTERVAL 365 DAY AND ts<=TIMESTAMP '{_AS_OF}'"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


@query("discharge_mean", cte("readings") + f" SELECT site_id, round(avg(CASE WHEN discharge>=0 THEN discharge END), 9) AS discharge_m3s FROM readings WHERE {_YEAR_SQL} GROUP BY 1")
def discharge_mean(spark, d):
    return features.discharge_features(frame(spark, d, "readings"), _as_of()).withColumn("discharge_m3s", F.round("discharge_m3s", 9))


@query("discharge_mean_array", cte("readings") + f", g AS (SELECT site_id, cast(ts AS date) AS day, sum(discharge) AS q FROM readings WHERE {_YEAR_SQL} GROUP BY 1,2) "
       "SELECT site_id, round(avg(CASE WHEN q>=0 THEN q END), 9) AS discharge_m3s FROM g GROUP BY 1")
def discharge_mean_array(spark, d):
    """One array per site with a value per day of a year."""
    recent = frame(spark, d, "readings").filter(features.in_trailing_days(F.col("ts"), _as_of()))
    days = recent.groupBy("site_id", F.col("ts").cast("date").alias("day")).agg(F.sum("discharge").alias("q"))
    series = days.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("day", "q"))).alias("s"))
    values = F.transform("s", lambda x: x["q"])
    return series.select("site_id", F.round(features.discharge_mean(values), 9).alias("discharge_m3s"))


_QUAKES = ("q AS (SELECT lat, lon, count(*) AS n FROM quakes WHERE magnitude>=2 AND ts>=TIMESTAMP '2016-01-01' AND ts<TIMESTAMP '2026-01-01' GROUP BY 1,2), "
           f"h AS (SELECT s.site_id, sum(q.n) AS n FROM sites s JOIN q ON abs(s.lat-q.lat)<1 AND {hav('s', 'q')}<=100 GROUP BY 1), "
           "qf AS (SELECT site_id, coalesce(n, 0)::bigint AS earthquake_count_10yr, round(coalesce(n, 0)/(pi()*10000/10000)/10, 9) AS earthquake_density FROM sites LEFT JOIN h USING (site_id))")


@query("quake_density", cte("sites", "quakes") + ", " + _QUAKES + " SELECT * FROM qf")
def quake_density(spark, d):
    return features.quake_features(frame(spark, d, "sites"), frame(spark, d, "quakes")).withColumn(
        "earthquake_density", F.round("earthquake_density", 9))


@query("wind_direction_consistency", cte("readings") + " SELECT site_id, round(sqrt(pow(avg(speed*cos(radians(direction_deg))),2)+pow(avg(speed*sin(radians(direction_deg))),2))/avg(speed), 6) AS direction_consistency FROM readings GROUP BY 1")
def wind_direction_consistency(spark, d):
    return features.direction_consistency(frame(spark, d, "readings")).withColumn("direction_consistency", F.round("direction_consistency", 6))


@query("watershed_ndvi", cte("watershed") + " SELECT site_id, round(avg((nir-red)/nullif(nir+red, 0)), 6) AS watershed_ndvi FROM watershed GROUP BY 1")
def watershed_ndvi(spark, d):
    return features.ndvi_mean(frame(spark, d, "watershed")).withColumn("watershed_ndvi", F.round("watershed_ndvi", 6))


@query("assemble_measurements", cte("sites", "climatology", "terrain", "readings", "quakes") + f", pw AS ({_POWER}), te AS ({_TERRAIN}), "
       f"di AS (SELECT site_id, round(avg(CASE WHEN discharge>=0 THEN discharge END), 9) AS discharge_m3s FROM readings WHERE {_YEAR_SQL} GROUP BY 1), " + _QUAKES +
       " SELECT s.site_id, pw.* EXCLUDE (site_id), te.* EXCLUDE (site_id), di.discharge_m3s, qf.earthquake_count_10yr, qf.earthquake_density FROM sites s "
       "LEFT JOIN pw USING (site_id) LEFT JOIN te USING (site_id) LEFT JOIN di USING (site_id) LEFT JOIN qf USING (site_id)")
def assemble_measurements(spark, d):
    sites = frame(spark, d, "sites").select("site_id", "lat", "lon")
    out = features.assemble(
        sites, _power(spark, d), features.terrain_features(_stencil(spark, d)),
        features.discharge_features(frame(spark, d, "readings"), _as_of()), features.quake_features(sites, frame(spark, d, "quakes")))
    return out.drop("lat", "lon").withColumns({
        "slope_degrees": F.round("slope_degrees", 6), "discharge_m3s": F.round("discharge_m3s", 9),
        "earthquake_density": F.round("earthquake_density", 9)})


_EXT = ("abs(lat)/90 AS abs_lat, cos(radians(lat)) AS cos_lat, lon/180 AS lon_norm, pow(lat/90, 2) AS lat_sq, sin(radians(lon)) AS sin_lon, "
        "cos(radians(lon)) AS cos_lon, abs(lat-35)/90 AS belt_distance, CASE WHEN abs(lat)>30 THEN 1::double ELSE 0::double END AS high_lat")
_EXT_NAMES = ("abs_lat", "cos_lat", "lon_norm", "lat_sq", "sin_lon", "cos_lon", "belt_distance", "high_lat")


@query("external_features", cte("sites") + f", f AS (SELECT site_id, {_EXT} FROM sites) SELECT site_id, " + ", ".join(f"round({n}, 6)+0 AS {n}" for n in _EXT_NAMES) + " FROM f")
def external_features(spark, d):
    out = frame(spark, d, "sites").select("site_id", *features.external_features(F.col("lat"), F.col("lon")))
    return out.select("site_id", *[(F.round(n, 6) + 0.0).alias(n) for n in _EXT_NAMES])


@query("geo_baseline_features", cte("sites") + " SELECT site_id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(abs(lat), 6) AS abs_lat, round(cos(radians(lat)), 6) AS cos_lat, "
       "round(sin(radians(lon)), 6)+0 AS sin_lon, round(cos(radians(lon)), 6)+0 AS cos_lon FROM sites")
def geo_baseline_features(spark, d):
    out = frame(spark, d, "sites").select("site_id", *features.geo_features(F.col("lat"), F.col("lon")))
    return out.select("site_id", *[(F.round(n, 6) + 0.0).alias(n) for n in out.columns if n != "site_id"])


@query("year_filter", cte("locations") + " SELECT loc_id, cast(operating_year AS int) AS year FROM locations WHERE regexp_matches(operating_year, '^[0-9]{4}$')")
def year_filter(spark, d):
    y = year4(F.col("operating_year"))
    return frame(spark, d, "locations").select("loc_id", y.alias("year")).filter(F.col("year").isNotNull())
