"""Factor and scoring queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.factors import CATALOG, TYPE_WEIGHTS, catalog_frame, weights_frame, with_measurements
from sitegauge.functions.scalar import (
    ENERGY_TYPES, confidence_band, event_risk_band, hash_order, ml_verdict, report_round, risk_gauge_band)
from sitegauge.operators import scoring
from sitegauge.operators.ranking import exact_rank, top_n
from sitegauge.operators.scoring import Scorecard
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.registry import add, query

# Oracle text of every factor, written from the score tables, not from the Columns.
FACTOR_SQL = {
    "land_cover": "0.5::double",
    "terrain_slope": "CASE WHEN slope_degrees IS NULL THEN 0.5::double ELSE greatest(0::double, least(1::double, 1::double - slope_degrees/15::double)) END",
    "terrain_elevation": "CASE WHEN elevation_m IS NULL THEN 0.5::double WHEN elevation_m<0 THEN 0 WHEN elevation_m<10 THEN 0.3::double WHEN elevation_m<100 THEN 0.7::double WHEN elevation_m<=2000 THEN 1 WHEN elevation_m<=3000 THEN 0.6::double ELSE 0.3::double END",
    "solar_irradiance": "(SELECT CASE WHEN g<=2 THEN 0.1::double WHEN g<=3 THEN 0.3::double WHEN g<=4 THEN 0.5::double WHEN g<=5 THEN 0.7::double WHEN g<=6 THEN 0.85::double ELSE 1 END FROM (SELECT coalesce(ghi_kwh_m2_day, CASE WHEN abs(lat)<=25 THEN 6 WHEN abs(lat)<=35 THEN 5.5::double WHEN abs(lat)<=45 THEN 4.5::double WHEN abs(lat)<=55 THEN 3.5::double ELSE 2.5::double END) AS g))",
    "cloud_coverage": "CASE WHEN cloud_fraction IS NULL THEN 0.5::double ELSE greatest(0::double, least(1::double, 1::double-cloud_fraction)) END",
    "temperature_effect": "CASE WHEN avg_temp_c IS NULL THEN 0.5::double WHEN avg_temp_c<-10 THEN 0.3::double WHEN avg_temp_c<10 THEN 0.6::double+0.4::double*(avg_temp_c+10)/20 WHEN avg_temp_c<=25 THEN 1 WHEN avg_temp_c<=35 THEN 1-0.2::double*(avg_temp_c-25)/10 WHEN avg_temp_c<=45 THEN 0.8::double-0.3::double*(avg_temp_c-35)/10 ELSE 0.3::double END",
    "wind_speed": "(SELECT CASE WHEN g<3 THEN 0::double WHEN g<4 THEN 0.1::double WHEN g<5 THEN 0.3::double WHEN g<6 THEN 0.5::double WHEN g<7 THEN 0.7::double WHEN g<9 THEN 0.9::double ELSE 1 END FROM (SELECT coalesce(wind_speed_ms, CASE WHEN abs(lat)>=35 AND abs(lat)<=55 THEN 7 WHEN abs(lat)>=25 AND abs(lat)<35 THEN 5.5::double WHEN abs(lat)<25 THEN 4.5::double ELSE 6 END) AS g))",
    "wind_direction_consistency": "CASE WHEN direction_consistency IS NULL THEN 0.5::double ELSE greatest(0::double, least(1::double, direction_consistency)) END",
    "terrain_roughness": "CASE WHEN roughness_length_m IS NULL THEN 0.5::double WHEN roughness_length_m<=0.001::double THEN 1 WHEN roughness_length_m<=0.03::double THEN 0.9::double WHEN roughness_length_m<=0.1::double THEN 0.8::double WHEN roughness_length_m<=0.3::double THEN 0.5::double WHEN roughness_length_m<=1 THEN 0.2::double ELSE 0.1::double END",
    "water_flow": "CASE WHEN discharge_m3s IS NULL THEN 0.5::double WHEN discharge_m3s<=0 THEN 0 WHEN discharge_m3s<1 THEN 0.2::double WHEN discharge_m3s<10 THEN 0.5::double WHEN discharge_m3s<100 THEN 0.8::double ELSE 1 END",
    "elevation_drop": "CASE WHEN head_m IS NULL THEN 0.5::double WHEN head_m<2 THEN 0.1::double WHEN head_m<10 THEN 0.4::double WHEN head_m<50 THEN 0.7::double WHEN head_m<200 THEN 0.9::double ELSE 1 END",
    "watershed_health": "CASE WHEN watershed_ndvi IS NOT NULL THEN CASE WHEN watershed_ndvi>=0.6::double THEN 1 WHEN watershed_ndvi>=0.3::double THEN 0.4::double+(watershed_ndvi-0.3::double)/0.3::double*0.6::double ELSE 0.2::double END WHEN precipitation_mm_day IS NOT NULL THEN CASE WHEN precipitation_mm_day>=5 THEN 0.95::double WHEN precipitation_mm_day>=3 THEN 0.8::double WHEN precipitation_mm_day>=1.5::double THEN 0.6::double WHEN precipitation_mm_day>=0.5::double THEN 0.4::double ELSE 0.2::double END ELSE 0.5::double END",
    "heat_flow": "CASE WHEN heat_flow_mwm2 IS NULL THEN 0.5::double WHEN heat_flow_mwm2<40 THEN 0 WHEN heat_flow_mwm2<65 THEN 0.2::double WHEN heat_flow_mwm2<80 THEN 0.4::double WHEN heat_flow_mwm2<120 THEN 0.7::double WHEN heat_flow_mwm2<200 THEN 0.9::double ELSE 1 END",
    "fault_proximity": "CASE WHEN fault_distance_km IS NULL THEN 0.5::double WHEN fault_distance_km<1 THEN 1 WHEN fault_distance_km<5 THEN 0.8::double WHEN fault_distance_km<15 THEN 0.5::double WHEN fault_distance_km<50 THEN 0.2::double ELSE 0.05::double END",
    "seismic_activity": "CASE WHEN earthquake_density IS NULL THEN 0.5::double WHEN earthquake_density<=0 THEN 0.2::double WHEN earthquake_density<=5 THEN 0.5::double WHEN earthquake_density<=20 THEN 0.8::double WHEN earthquake_density<=50 THEN 1 ELSE 0.7::double END",
    "grid_proximity": "CASE WHEN grid_distance_km IS NULL THEN 0.5::double WHEN grid_distance_km<1 THEN 1 WHEN grid_distance_km<5 THEN 0.85::double WHEN grid_distance_km<15 THEN 0.6::double WHEN grid_distance_km<30 THEN 0.35::double WHEN grid_distance_km<50 THEN 0.15::double ELSE 0.05::double END",
    "road_access": "CASE WHEN road_distance_km IS NULL THEN 0.5::double WHEN road_distance_km<0.5::double THEN 1 WHEN road_distance_km<2 THEN 0.8::double WHEN road_distance_km<5 THEN 0.6::double WHEN road_distance_km<15 THEN 0.3::double ELSE 0.1::double END",
    "flood_risk": "CASE WHEN flood_zone IS NOT NULL THEN CASE upper(trim(flood_zone)) WHEN 'X' THEN 0.9::double WHEN 'X500_SHADED' THEN 0.9::double WHEN 'X500' THEN 0.7::double WHEN 'A' THEN 0.2::double WHEN 'AE' THEN 0.2::double WHEN 'AO' THEN 0.2::double WHEN 'AH' THEN 0.2::double WHEN 'V' THEN 0 WHEN 'VE' THEN 0 ELSE 0.5::double END WHEN flood_probability IS NOT NULL THEN greatest(0::double, least(1::double, 1::double-flood_probability)) ELSE 0.5::double END",
    "protected_area": "CASE WHEN coalesce(in_protected_area, false) THEN 0 WHEN protected_area_distance_km IS NULL THEN 0.5::double WHEN protected_area_distance_km<1 THEN 0.3::double WHEN protected_area_distance_km<5 THEN 0.7::double ELSE 1::double END",
}

_MATRIX = ", ".join(f"cast({sql} AS double) AS {key}" for key, sql in FACTOR_SQL.items())
FACTORS_CTE = cte("sites") + f", factors AS (SELECT *, {_MATRIX} FROM sites)"


def overall_sql(energy_type: str, weights: dict[str, float] | None = None, off: tuple[str, ...] = ()) -> str:
    w = weights or TYPE_WEIGHTS[energy_type]
    active = [(f.key, w[f.name]) for f in CATALOG if f.applies_to(energy_type) and f.name not in off]
    top = "+".join(f"{x}::double*{k}" for k, x in active)
    return f"({top})/({'+'.join(f'{x}::double' for _, x in active)})"


def sites(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "sites")


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _one_factor(key: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = next(f for f in CATALOG if f.key == key)
        return with_measurements(sites(spark, d)).select("site_id", F.round(f.score(), 9).alias("score"))
    add(f"factor_{key}", run,
        cte("sites") + f" SELECT site_id, round(cast({FACTOR_SQL[key]} AS double), 9) AS score FROM sites")


for _key in FACTOR_SQL:
    _one_factor(_key)


@query("factor_matrix", FACTORS_CTE + " SELECT site_id, "
       + ", ".join(f"round({k}, 9) AS {k}" for k in FACTOR_SQL) + " FROM factors")
def factor_matrix(spark, d):
    return _rounded(scoring.factor_matrix(sites(spark, d)), *FACTOR_SQL)


_CATALOG_SQL = " UNION ALL ".join(
    f"SELECT {i}::int AS position, '{f.name}' AS factor, '{t}' AS energy_type, {TYPE_WEIGHTS[t][f.name]}::double AS weight"
    for t in ENERGY_TYPES for i, f in enumerate(CATALOG) if f.applies_to(t))


@query("factor_catalog", cte("sites") + f", w AS ({_CATALOG_SQL}) SELECT s.energy_type, w.position, w.factor, count(*) AS n_sites "
       "FROM sites s JOIN w ON w.energy_type=s.energy_type GROUP BY 1,2,3")
def factor_catalog(spark, d):
    """Which factors apply to how many sites; both catalog sides are constants."""
    counts = sites(spark, d).groupBy("energy_type").agg(F.count(F.lit(1)).alias("n_sites"))
    every = F.array(*[F.lit(t) for t in ENERGY_TYPES])
    kinds = F.when(F.array_contains("energy_types", "all"), every).otherwise(F.col("energy_types"))
    cat = catalog_frame(spark).select("position", "factor", F.explode(kinds).alias("energy_type"))
    return F.broadcast(cat).join(counts, "energy_type").select("energy_type", "position", "factor", "n_sites")


@query("default_weights", cte("sites") + f", w AS ({_CATALOG_SQL}) SELECT s.energy_type, count(*) AS n_rows, "
       "round(sum(w.weight), 6) AS weight_sum FROM sites s JOIN w ON w.energy_type=s.energy_type GROUP BY 1")
def default_weights(spark, d):
    w = F.broadcast(weights_frame(spark))
    return sites(spark, d).join(w, "energy_type").groupBy("energy_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 6).alias("weight_sum"))


@query("score_sites", FACTORS_CTE + f" SELECT site_id, lat, lon, round({overall_sql('solar')}, 9) AS overall_score FROM factors")
def score_sites(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("solar"))
    return _rounded(out.select("site_id", "lat", "lon", "overall_score"), "overall_score")


@query("batch_score", FACTORS_CTE + " SELECT site_id, energy_type, round(CASE energy_type "
       + " ".join(f"WHEN '{t}' THEN {overall_sql(t)}" for t in ENERGY_TYPES) + " END, 9) AS overall_score FROM factors")
def batch_score(spark, d):
    """Every site with the scorecard of its own energy type."""
    every = scoring.score_all_types(sites(spark, d), ["site_id", F.col("energy_type").alias("own_type")])
    own = every.filter(F.col("own_type") == F.col("energy_type"))
    return _rounded(own.select("site_id", "energy_type", "overall_score"), "overall_score")


_ALL_SQL = " UNION ALL ".join(
    f"SELECT site_id, '{t}' AS energy_type, {overall_sql(t)} AS overall_score FROM factors" for t in ENERGY_TYPES)


@query("score_all_types", FACTORS_CTE + f" SELECT site_id, energy_type, round(overall_score, 9) AS overall_score FROM ({_ALL_SQL})")
def score_all_types(spark, d):
    return _rounded(scoring.score_all_types(sites(spark, d)), "overall_score")


@query("best_type", FACTORS_CTE + f", a AS ({_ALL_SQL}) SELECT site_id, round(max(overall_score), 9) AS best_score, "
       "arg_max(energy_type, (round(overall_score, 12), energy_type)) AS best_type FROM a GROUP BY site_id")
def best_type(spark, d):
    every = scoring.score_all_types(sites(spark, d))
    return every.groupBy("site_id").agg(
        F.round(F.max("overall_score"), 9).alias("best_score"),
        F.max_by("energy_type", F.struct(F.round("overall_score", 12), "energy_type")).alias("best_type"))


_CUSTOM = {"Solar Irradiance": 4.0, "Flood Risk": 0.0, "Grid Proximity": 2.5}


@query("custom_weights", FACTORS_CTE + " SELECT site_id, round("
       + overall_sql("solar", {**TYPE_WEIGHTS["solar"], **_CUSTOM}) + ", 9) AS overall_score FROM factors")
def custom_weights(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("solar", _CUSTOM))
    return _rounded(out.select("site_id", "overall_score"), "overall_score")


@query("factor_toggle", FACTORS_CTE + " SELECT site_id, round("
       + overall_sql("wind", off=("Flood Risk", "Land Cover")) + ", 9) AS overall_score FROM factors")
def factor_toggle(spark, d):
    card = Scorecard.of("wind").disable("Flood Risk").disable("Land Cover")
    return _rounded(scoring.score_sites(sites(spark, d), card).select("site_id", "overall_score"), "overall_score")


@query("custom_factor", FACTORS_CTE + ", x AS (SELECT *, greatest(0::double, least(1::double, 1-abs(lat)/90)) AS equator FROM factors) "
       "SELECT site_id, round((" + "+".join(f"{TYPE_WEIGHTS['hydro'][f.name]}::double*{f.key}" for f in CATALOG if f.applies_to("hydro"))
       + "+0.7::double*equator)/(" + "+".join(f"{w}::double" for w in TYPE_WEIGHTS["hydro"].values()) + "+0.7::double), 9) AS overall_score FROM x")
def custom_factor(spark, d):
    extra = scoring.register_factor("Equator Proximity", ("hydro",), 0.7, lambda: 1.0 - F.abs("lat") / 90.0)
    out = scoring.score_sites(sites(spark, d), Scorecard.of("hydro", extra=[extra]))
    return _rounded(out.select("site_id", "overall_score"), "overall_score")


@query("describe_engine", cte("sites") + f", w AS ({_CATALOG_SQL}), c AS (SELECT energy_type, count(*) AS total_factors, "
       "count(*) FILTER (WHERE NOT (energy_type='wind' AND factor='Flood Risk')) AS active_factors, "
       "string_agg(factor, '|' ORDER BY position) AS factors, round(sum(weight), 6) AS weight_sum FROM w GROUP BY 1) "
       "SELECT c.*, n.n_sites FROM c JOIN (SELECT energy_type, count(*) AS n_sites FROM sites GROUP BY 1) n USING (energy_type)")
def describe_engine(spark, d):
    cards = [Scorecard.of(t) if t != "wind" else Scorecard.of(t).disable("Flood Risk") for t in ENERGY_TYPES]
    rows = None
    for card in cards:
        line = scoring.describe(card, spark).withColumn("energy_type", F.lit(card.energy_type))
        rows = line if rows is None else rows.unionByName(line)
    listing = rows.groupBy("energy_type").agg(
        F.count(F.lit(1)).alias("total_factors"), F.sum(F.col("enabled").cast("bigint")).alias("active_factors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "factor"))), lambda s: s["factor"]), "|").alias("factors"),
        F.round(F.sum("weight"), 6).alias("weight_sum"))
    counts = sites(spark, d).groupBy("energy_type").agg(F.count(F.lit(1)).alias("n_sites"))
    return listing.join(counts, "energy_type")


# -- reports ----------------------------------------------------------------

_SOLAR = [f for f in CATALOG if f.applies_to("solar")]


@query("score_report", FACTORS_CTE + ", long AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{f.name}' AS factor, {f.key} AS score, {TYPE_WEIGHTS['solar'][f.name]}::double AS weight FROM factors" for f in _SOLAR)
    + ") SELECT site_id, factor, cast(round_even(cast(round(score, 9) AS decimal(28,9)), 4) AS double) AS score, cast(round_even(cast(round(weight, 9) AS decimal(28,9)), 4) AS double) AS weight FROM long")
def score_report(spark, d):
    out = scoring.rounded_report(scoring.score_sites(sites(spark, d), Scorecard.of("solar"), detail=True))
    long = out.select("site_id", "factor_weights", F.explode("factor_scores").alias("factor", "score"))
    return long.select("site_id", "factor", "score", F.element_at("factor_weights", F.col("factor")).alias("weight"))


@query("round_report", FACTORS_CTE + f" SELECT site_id, cast(round_even(cast(round({overall_sql('geothermal')}, 9) AS decimal(28,9)), 4) AS double) AS overall_score FROM factors")
def round_report(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("geothermal"))
    return out.select("site_id", report_round("overall_score", 4).alias("overall_score"))


@query("split_real_estimated", FACTORS_CTE + " SELECT site_id, cast("
       + "+".join(f"(CASE WHEN {f.key}<>0.5 THEN 1 ELSE 0 END)" for f in _SOLAR) + " AS int) AS n_measured, cast("
       + "+".join(f"(CASE WHEN {f.key}=0.5 THEN 1 ELSE 0 END)" for f in _SOLAR) + " AS int) AS n_estimated FROM factors")
def split_real_estimated(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("solar"), detail=True)
    real, guessed = scoring.split_measured(F.col("factor_scores"))
    return out.select("site_id", F.size(real).alias("n_measured"), F.size(guessed).alias("n_estimated"))


@query("data_sources_map", cte("sites") + ", long AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{m}' AS name, '{s}' AS source, cast({m} AS double) AS value FROM sites" for m, s in scoring.MEASUREMENT_SOURCES.items())
    + ") SELECT site_id, name, source, cast(round_even(cast(round(value, 9) AS decimal(28,9)), 3) AS double) AS value FROM long WHERE value IS NOT NULL")
def data_sources_map(spark, d):
    out = scoring.data_sources(sites(spark, d))
    return out.select("site_id", F.explode("data_sources").alias("name", "v")).select("site_id", "name", "v.source", "v.value")


@query("band_confidence", FACTORS_CTE + f", s AS (SELECT site_id, round({overall_sql('solar')}, 9) AS x FROM factors) "
       "SELECT site_id, CASE WHEN x>0.7::double THEN 'high' WHEN x>0.4::double THEN 'moderate' ELSE 'low' END AS confidence FROM s")
def band_confidence(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("solar"))
    return out.select("site_id", confidence_band(F.col("overall_score")).alias("confidence"))


@query("band_risk_gauge", FACTORS_CTE + f", s AS (SELECT site_id, round({overall_sql('solar')}, 9) AS x FROM factors) "
       "SELECT site_id, CASE WHEN x<0.3::double THEN 'lightgreen' WHEN x<0.6::double THEN 'gold' ELSE 'salmon' END AS band FROM s")
def band_risk_gauge(spark, d):
    out = scoring.score_sites(sites(spark, d), Scorecard.of("solar"))
    return out.select("site_id", risk_gauge_band(F.col("overall_score")).alias("band"))


@query("ml_verdict", cte("embedded") + " SELECT vec_id, CASE WHEN ml_score>0.8::double THEN 'resembles known sites' "
       "WHEN ml_score<0.3::double THEN 'does not resemble known sites' END AS verdict FROM embedded")
def verdicts(spark, d):
    return frame(spark, d, "embedded").select("vec_id", ml_verdict(F.col("ml_score")).alias("verdict"))


@query("band_event_risk", cte("embedded") + " SELECT vec_id, CASE WHEN ml_score>0.3::double THEN 'High' "
       "WHEN ml_score>0.1::double THEN 'Medium' ELSE 'Low' END AS band FROM embedded")
def band_event_risk(spark, d):
    return frame(spark, d, "embedded").select("vec_id", event_risk_band(F.col("ml_score")).alias("band"))


# -- presets and samples ----------------------------------------------------

_PRESETS = ", ".join(f"({-(i + 1)}::bigint, '{n}', {la}::double, {lo}::double)" for i, (n, la, lo, _) in enumerate(scoring.PRESET_SITES))
_BARE = ", ".join(f"NULL::double AS {c}" for c in (
    "ghi_kwh_m2_day", "wind_speed_ms", "avg_temp_c", "cloud_fraction", "precipitation_mm_day", "elevation_m", "slope_degrees",
    "head_m", "discharge_m3s", "earthquake_density", "direction_consistency", "roughness_length_m", "watershed_ndvi",
    "heat_flow_mwm2", "fault_distance_km", "grid_distance_km", "road_distance_km", "flood_probability", "protected_area_distance_km"))
_COMPARE_SQL = (cte("sites", "embedded") + f", everything AS (SELECT * EXCLUDE (energy_type, label), 'site' AS name FROM sites UNION ALL BY NAME "
                f"SELECT p.id AS site_id, p.lat, p.lon, {_BARE}, NULL::varchar AS flood_zone, NULL::boolean AS in_protected_area, p.name FROM (VALUES {_PRESETS}) p(id, name, lat, lon)), "
                "near AS (SELECT site_id, ml_score FROM (SELECT s.site_id, e.ml_score, row_number() OVER (PARTITION BY s.site_id ORDER BY sqrt((s.lat-e.lat)*(s.lat-e.lat)+(s.lon-e.lon)*(s.lon-e.lon)), e.vec_id) AS rn "
                "FROM everything s JOIN embedded e ON abs(s.lat-e.lat)<=0.5 AND abs(s.lon-e.lon)<=0.5 AND sqrt((s.lat-e.lat)*(s.lat-e.lat)+(s.lon-e.lon)*(s.lon-e.lon))<0.5) WHERE rn=1), "
                f"factors AS (SELECT *, {_MATRIX} FROM everything), s AS (SELECT site_id, name, round({overall_sql('solar')}, 9) AS overall_score FROM factors) "
                "SELECT site_id, name, overall_score, ml_score, row_number() OVER (ORDER BY overall_score DESC, site_id) AS place FROM s LEFT JOIN near USING (site_id)")


@query("compare_presets", _COMPARE_SQL)
def compare_presets(spark, d):
    """All sites and all presets with factor and model score, ranked by the former."""
    own = sites(spark, d).drop("energy_type", "label").withColumn("name", F.lit("site"))
    both = own.unionByName(scoring.presets_frame(spark).drop("state"), allowMissingColumns=True)
    scored = _rounded(scoring.score_sites(both, Scorecard.of("solar")), "overall_score").select("site_id", "name", "overall_score")
    model = scoring.ml_score_nearest(both, frame(spark, d, "embedded")).select("site_id", "ml_score")
    ranked = exact_rank(scored.withColumn("_low", -F.col("overall_score")), [], ["_low", "site_id"], "place")
    return ranked.join(model, "site_id", "left").select("site_id", "name", "overall_score", "ml_score", "place")


@query("pos_neg_mean_score", FACTORS_CTE + ", s AS (SELECT site_id, energy_type, label, CASE energy_type "
       + " ".join(f"WHEN '{t}' THEN {overall_sql(t)}" for t in ENERGY_TYPES) + " END AS x, row_number() OVER (PARTITION BY energy_type, label ORDER BY site_id) AS rn FROM factors) "
       "SELECT energy_type, label, count(*) AS n, round(avg(x), 9) AS mean_score FROM s WHERE rn<=10 GROUP BY 1,2")
def pos_neg_mean_score(spark, d):
    first = top_n(sites(spark, d), ["energy_type", "label"], ["site_id"], 10)
    every = scoring.score_all_types(first, ["site_id", "label", F.col("energy_type").alias("own")])
    return every.filter(F.col("own") == F.col("energy_type")).groupBy("energy_type", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("overall_score"), 9).alias("mean_score"))


# -- model branch -----------------------------------------------------------

_NEAR_SQL = (cte("sites", "embedded") + ", pairs AS (SELECT s.site_id, e.vec_id, e.ml_score, sqrt((s.lat-e.lat)*(s.lat-e.lat)+(s.lon-e.lon)*(s.lon-e.lon)) AS dist "
             "FROM sites s JOIN embedded e ON abs(s.lat-e.lat)<=0.5 AND abs(s.lon-e.lon)<=0.5), "
             "near AS (SELECT site_id, vec_id, ml_score, dist FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dist, vec_id) AS rn "
             "FROM pairs WHERE dist {op} 0.5) WHERE rn=1)")


@query("ml_score_nearest", _NEAR_SQL.format(op="<") + " SELECT s.site_id, n.vec_id AS nearest_id, round(n.dist, 9) AS distance, n.ml_score, "
       "n.ml_score IS NOT NULL AS ml_available FROM sites s LEFT JOIN near n USING (site_id)")
def ml_score_nearest(spark, d):
    out = scoring.ml_score_nearest(sites(spark, d), frame(spark, d, "embedded"))
    return out.select("site_id", "nearest_id", F.round("distance", 9).alias("distance"), "ml_score", "ml_available")


@query("combined_score", _NEAR_SQL.format(op="<=") + f", factors AS (SELECT *, {_MATRIX} FROM sites), "
       f"s AS (SELECT f.site_id, {overall_sql('solar')} AS x, n.ml_score FROM factors f LEFT JOIN near n USING (site_id)), "
       "c AS (SELECT *, CASE WHEN ml_score IS NULL THEN x ELSE 0.6::double*ml_score+0.4::double*x END AS both_score FROM s) "
       "SELECT site_id, round(x, 9) AS overall_score, round(both_score, 9) AS combined_score, "
       "CASE WHEN round(both_score, 9)>0.7::double THEN 'high' WHEN round(both_score, 9)>0.4::double THEN 'moderate' ELSE 'low' END AS confidence FROM c")
def combined(spark, d):
    with_ml = scoring.ml_score_nearest(sites(spark, d), frame(spark, d, "embedded"), inclusive=True)
    out = scoring.suitability_report(with_ml, Scorecard.of("solar"), "combined")
    return _rounded(out.select("site_id", "overall_score", "combined_score", "confidence"), "overall_score", "combined_score")


@query("hash_order_sum", cte("sites") + " SELECT sum(('0x' || substr(md5('42:' || cast(site_id AS varchar)), 1, 8))::bigint % 1000)::bigint AS total FROM sites")
def hash_order_sum(spark, d):
    return sites(spark, d).agg(F.sum(hash_order(F.col("site_id")) % 1000).alias("total"))
