"""Climate-risk queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import climate
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.registry import query

_YEAR = "cast(2020+site_id%90 AS int)"
_KNOTS = ", ".join(f"('{s}', '{v}', {y}, {d}::double)" for s, spec in climate.SCENARIOS.items()
                   for v in ("temperature", "precipitation") for y, d in zip(climate.KNOT_YEARS, spec[v]))
_SEGMENTS = (f"knots AS (SELECT * FROM (VALUES {_KNOTS}) k(scenario, variable, year, delta)), "
             "seg AS (SELECT scenario, variable, year AS y0, delta AS d0, lead(year) OVER w AS y1, lead(delta) OVER w AS d1 "
             "FROM knots WINDOW w AS (PARTITION BY scenario, variable ORDER BY year))")


def _delta(variable: str, scenario: str, year: str) -> str:
    return (f"(SELECT coalesce(max(CASE WHEN greatest(2030, least(2100, {year}))>=y0 AND greatest(2030, least(2100, {year}))<y1 "
            f"THEN d0+(greatest(2030, least(2100, {year}))-y0)/(y1-y0)::double*(d1-d0) END), "
            f"max(CASE WHEN y0=2100 THEN d0 END)) FROM seg WHERE seg.scenario={scenario} AND variable='{variable}')")


_SCEN = ("CASE site_id%6 WHEN 0 THEN 'ssp126' WHEN 1 THEN 'SSP245' WHEN 2 THEN 'Ssp370' WHEN 3 THEN 'SSP585' WHEN 4 THEN 'RCP85' ELSE 'SSP126' END")
_KNOWN = f"CASE WHEN upper({_SCEN}) IN ('SSP126','SSP245','SSP370','SSP585') THEN upper({_SCEN}) ELSE 'SSP245' END"


def _assessed(base: str) -> str:
    """Common oracle CTEs over ``base`` rows that carry scenario and target_year."""
    return (f", base AS ({base}), dl AS (SELECT *, {_delta('temperature', 'base.scenario', 'base.target_year')} AS dt, "
            f"{_delta('precipitation', 'base.scenario', 'base.target_year')} AS dp FROM base), "
            "cur AS (SELECT *, coalesce(ghi_kwh_m2_day, 4.5::double) AS g, coalesce(wind_speed_ms, 5::double) AS w, coalesce(avg_temp_c, 15::double) AS t, "
            "coalesce(precipitation_mm_day, 2::double) AS p FROM dl), "
            "ev AS (SELECT *, g*365*(1-0.005::double*dt) AS ghi, w*(1+0.01::double*dt) AS wind, "
            "CASE WHEN abs(lat)>5 AND abs(lat)<30 THEN 0.15::double*(1+0.1::double*dt) ELSE 0::double END AS cyclone, "
            "CASE WHEN t>20 THEN greatest(0::double, least(0.8::double, (t+dt-25)*0.05::double)) ELSE 0::double END AS heat, "
            "least(0.5::double, p*0.03::double*(1+dp/100)) AS flood, greatest(0::double, 0.5::double-0.05::double*p)*(1+0.05::double*dt) AS drought FROM cur), "
            "rk AS (SELECT *, least(1::double, (0.3::double*heat+0.25::double*flood+0.25::double*cyclone+0.2::double*drought)*"
            "CASE scenario WHEN 'SSP126' THEN 0.8::double WHEN 'SSP370' THEN 1.2::double WHEN 'SSP585' THEN 1.5::double ELSE 1::double END) AS risk, "
            "0.1::double+0.02::double*dt AS spread FROM ev)")


_ONE = cte("sites") + ", " + _SEGMENTS + _assessed(f"SELECT *, {_KNOWN} AS scenario, {_YEAR} AS target_year FROM sites")


def _assess(spark, d):
    scenario = F.expr(_SCEN)
    year = F.expr(_YEAR)
    return climate.assess(frame(spark, d, "sites"), scenario, year)


@query("ssp_interpolate", cte("sites") + ", " + _SEGMENTS + f", base AS (SELECT site_id, s.scenario, {_YEAR} AS target_year FROM sites, (SELECT DISTINCT scenario FROM knots) s) "
       f"SELECT site_id, scenario, target_year, round({_delta('temperature', 'base.scenario', 'base.target_year')}, 9) AS dt, "
       f"round({_delta('precipitation', 'base.scenario', 'base.target_year')}, 9) AS dp FROM base")
def ssp_interpolate(spark, d):
    rows = frame(spark, d, "sites").select(
        "site_id", F.expr(_YEAR).alias("target_year"), F.explode(F.array(*[F.lit(s) for s in climate.SCENARIOS])).alias("scenario"))
    return rows.select("site_id", "scenario", "target_year", *[
        F.round(climate.interpolate(F.col("scenario"), F.col("target_year"), v), 9).alias(n)
        for n, v in (("dt", "temperature"), ("dp", "precipitation"))])


@query("segment_lead", cte("sites") + ", " + _SEGMENTS + f", base AS (SELECT site_id, greatest(2030, least(2100, {_YEAR})) AS yr FROM sites) "
       "SELECT site_id, scenario, variable, round(d0+(yr-y0)/(y1-y0)::double*(d1-d0), 9) AS delta FROM base JOIN seg ON yr>=y0 AND (yr<y1 OR yr=y1 AND y1=2100)")
def segment_lead(spark, d):
    """The same interpolation through the segment table, unrolled to a row per year (a constant of some 570 rows)."""
    seg = climate.segments(climate.knots_frame(spark)).filter(F.col("y1").isNotNull())
    rows = frame(spark, d, "sites").select("site_id", F.greatest(F.lit(2030), F.least(F.lit(2100), F.expr(_YEAR))).alias("yr"))
    # The last segment of a scenario holds its end as well.
    last = F.when(F.col("y1") == 2100, F.col("y1")).otherwise(F.col("y1") - 1)
    yearly = seg.select("*", F.explode(F.sequence(F.col("y0"), last)).alias("yr"))
    joined = rows.join(F.broadcast(yearly), "yr")
    delta = F.col("d0") + (F.col("yr") - F.col("y0")) / (F.col("y1") - F.col("y0")).cast("double") * (F.col("d1") - F.col("d0"))
    return joined.select("site_id", "scenario", "variable", F.round(delta, 9).alias("delta"))


@query("climate_defaults", cte("sites") + f" SELECT site_id, {_KNOWN} AS scenario, coalesce(ghi_kwh_m2_day, 4.5::double) AS ghi, coalesce(wind_speed_ms, 5::double) AS wind, "
       "coalesce(avg_temp_c, 15::double) AS temp, coalesce(cloud_fraction, 0.5::double) AS cloud, coalesce(precipitation_mm_day, 2::double) AS precip FROM sites")
def climate_defaults(spark, d):
    out = climate.with_defaults(frame(spark, d, "sites"))
    return out.select("site_id", climate.known_scenario(F.expr(_SCEN)).alias("scenario"), F.col("now_ghi_kwh_m2_day").alias("ghi"),
                      F.col("now_wind_speed_ms").alias("wind"), F.col("now_avg_temp_c").alias("temp"),
                      F.col("now_cloud_fraction").alias("cloud"), F.col("now_precipitation_mm_day").alias("precip"))


@query("project_resources", _ONE + " SELECT site_id, cast(round_even(cast(round(ghi*0.9::double, 9) AS decimal(28,9)), 0) AS double) AS ghi_p10, cast(round_even(cast(round(ghi, 9) AS decimal(28,9)), 0) AS double) AS ghi_p50, cast(round_even(cast(round(ghi*1.1::double, 9) AS decimal(28,9)), 0) AS double) AS ghi_p90, "
       "cast(round_even(cast(round(wind*0.85::double, 9) AS decimal(28,9)), 1) AS double) AS wind_p10, cast(round_even(cast(round(wind, 9) AS decimal(28,9)), 1) AS double) AS wind_p50, cast(round_even(cast(round(wind*1.15::double, 9) AS decimal(28,9)), 1) AS double) AS wind_p90 FROM rk")
def project_resources(spark, d):
    out = _assess(spark, d)
    return out.select("site_id", *[F.col(f"solar_ghi_kwh_m2_year.{p}").alias(f"ghi_{p}") for p in ("p10", "p50", "p90")],
                      *[F.col(f"wind_speed_projection.{p}").alias(f"wind_{p}") for p in ("p10", "p50", "p90")])


_EVENTS = (("tropical_cyclone", "cyclone"), ("extreme_heat", "heat"), ("flooding", "flood"), ("drought", "drought"))


@query("extreme_event_probs", _ONE + ", ev4 AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{k}' AS event, cast(round_even(cast(round({c}, 9) AS decimal(28,9)), 3) AS double) AS probability FROM rk" for k, c in _EVENTS)
    + ") SELECT *, CASE WHEN probability>0.3::double THEN 'High' WHEN probability>0.1::double THEN 'Medium' ELSE 'Low' END AS band FROM ev4")
def extreme_event_probs(spark, d):
    from sitegauge.functions.scalar import event_risk_band
    out = _assess(spark, d).select("site_id", F.explode("extreme_event_probs").alias("event", "probability"))
    return out.withColumn("band", event_risk_band(F.col("probability")))


@query("risk_score", _ONE + " SELECT site_id, scenario, cast(round_even(cast(round(risk, 9) AS decimal(28,9)), 3) AS double) AS risk_score FROM rk")
def risk_score(spark, d):
    return _assess(spark, d).select("site_id", "scenario", "risk_score")


@query("risk_confidence", _ONE + " SELECT site_id, CASE WHEN coalesce(ghi_kwh_m2_day, wind_speed_ms, avg_temp_c, cloud_fraction, precipitation_mm_day) IS NOT NULL THEN 0.85::double ELSE 0.5::double END AS confidence, "
       "cast(round_even(cast(round(greatest(0::double, risk-spread), 9) AS decimal(28,9)), 3) AS double) AS low, cast(round_even(cast(round(least(1::double, risk+spread), 9) AS decimal(28,9)), 3) AS double) AS high FROM rk")
def risk_confidence(spark, d):
    return _assess(spark, d).select("site_id", "confidence", F.col("uncertainty_range")[0].alias("low"), F.col("uncertainty_range")[1].alias("high"))


@query("assess_climate_risk", _ONE + " SELECT site_id, scenario, target_year, cast(round_even(cast(round(risk, 9) AS decimal(28,9)), 3) AS double) AS risk_score, cast(round_even(cast(round(dt, 9) AS decimal(28,9)), 1) AS double) AS temperature_change_c, "
       "cast(round_even(cast(round(dp, 9) AS decimal(28,9)), 1) AS double) AS precipitation_change_pct, cast(round_even(cast(round(ghi, 9) AS decimal(28,9)), 0) AS double) AS ghi_p50, cast(round_even(cast(round(wind, 9) AS decimal(28,9)), 1) AS double) AS wind_p50 FROM rk")
def assess_climate_risk(spark, d):
    return _assess(spark, d).select("site_id", "scenario", "target_year", "risk_score", "temperature_change_c", "precipitation_change_pct",
                                    F.col("solar_ghi_kwh_m2_year.p50").alias("ghi_p50"), F.col("wind_speed_projection.p50").alias("wind_p50"))


_ALL = cte("sites") + ", " + _SEGMENTS + _assessed("SELECT sites.*, s.scenario, 2050 AS target_year FROM sites, (SELECT DISTINCT scenario FROM knots) s")


@query("compare_scenarios", _ALL + " SELECT site_id, " + ", ".join(
    f"max(CASE WHEN scenario='{s}' THEN cast(round_even(cast(round(risk, 9) AS decimal(28,9)), 3) AS double) END) AS risk_{s.lower()}, max(CASE WHEN scenario='{s}' THEN cast(round_even(cast(round(dt, 9) AS decimal(28,9)), 1) AS double) END) AS warming_{s.lower()}, "
    f"max(CASE WHEN scenario='{s}' THEN cast(round_even(cast(round(ghi, 9) AS decimal(28,9)), 0) AS double) END) AS ghi_p50_{s.lower()}" for s in climate.SCENARIOS) + " FROM rk GROUP BY site_id")
def compare_scenarios(spark, d):
    return climate.compare_scenarios(frame(spark, d, "sites"), F.lit(2050))


@query("assess_all_scenarios", _ALL + " SELECT site_id, scenario, cast(round_even(cast(round(risk, 9) AS decimal(28,9)), 3) AS double) AS risk_score FROM rk")
def assess_all_scenarios(spark, d):
    return climate.assess_all(frame(spark, d, "sites"), F.lit(2050)).select("site_id", "scenario", "risk_score")
