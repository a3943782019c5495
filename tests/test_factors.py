"""Boundary tables: each threshold, just beside it, missing and NaN."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions.factors import CATALOG, TYPE_WEIGHTS, Factor, catalog_frame, default_weights, with_measurements
from sitegauge.operators.scoring import Scorecard, combined_score, score_all_types, score_sites, split_measured

COLUMNS = (
    "lat double, lon double, ghi_kwh_m2_day double, wind_speed_ms double, avg_temp_c double, cloud_fraction double, "
    "precipitation_mm_day double, elevation_m double, slope_degrees double, head_m double, discharge_m3s double, "
    "earthquake_density double, direction_consistency double, roughness_length_m double, watershed_ndvi double, "
    "heat_flow_mwm2 double, fault_distance_km double, grid_distance_km double, road_distance_km double, "
    "flood_zone string, flood_probability double, in_protected_area boolean, protected_area_distance_km double")
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
E = 1e-9

CASES = {
    "terrain_slope": ("slope_degrees", [(0, 1), (7.5, .5), (15, 0), (40, 0), (-3, 1), (None, .5)]),
    "terrain_elevation": ("elevation_m", [(-E, 0), (0, .3), (10 - E, .3), (10, .7), (100 - E, .7), (100, 1), (2000, 1),
                                          (2000 + 1e-6, .6), (3000, .6), (3000 + 1e-6, .3), (None, .5)]),
    "solar_irradiance": ("ghi_kwh_m2_day", [(2, .1), (2 + E, .3), (3, .3), (4, .5), (5, .7), (6, .85), (6 + E, 1), (None, .85)]),
    "cloud_coverage": ("cloud_fraction", [(0, 1), (1, 0), (.25, .75), (-.5, 1), (2, 0), (None, .5)]),
    "temperature_effect": ("avg_temp_c", [(-10 - E, .3), (-10, .6), (0, .8), (10, 1), (25, 1), (30, .9), (35, .8), (45, .5),
                                          (45 + E, .3), (None, .5)]),
    "wind_speed": ("wind_speed_ms", [(3 - E, 0), (3, .1), (4, .3), (5, .5), (6, .7), (7, .9), (9 - E, .9), (9, 1), (None, .3)]),
    "wind_direction_consistency": ("direction_consistency", [(-1, 0), (.4, .4), (3, 1), (None, .5)]),
    "terrain_roughness": ("roughness_length_m", [(.001, 1), (.03, .9), (.1, .8), (.3, .5), (1, .2), (1 + E, .1), (None, .5)]),
    "water_flow": ("discharge_m3s", [(-1, 0), (0, 0), (.5, .2), (1, .5), (10, .8), (100, 1), (None, .5)]),
    "elevation_drop": ("head_m", [(2 - E, .1), (2, .4), (10, .7), (50, .9), (200, 1), (None, .5)]),
    "watershed_health": ("watershed_ndvi", [(.6, 1), (.3, .4), (.45, .7), (.3 - E, .2), (None, .5)]),
    "heat_flow": ("heat_flow_mwm2", [(40 - E, 0), (40, .2), (65, .4), (80, .7), (120, .9), (200, 1), (None, .5)]),
    "fault_proximity": ("fault_distance_km", [(1 - E, 1), (1, .8), (5, .5), (15, .2), (50, .05), (None, .5)]),
    "seismic_activity": ("earthquake_density", [(0, .2), (E, .5), (5, .5), (20, .8), (50, 1), (50.1, .7), (None, .5)]),
    "grid_proximity": ("grid_distance_km", [(1 - E, 1), (1, .85), (5, .6), (15, .35), (30, .15), (50, .05), (None, .5)]),
    "road_access": ("road_distance_km", [(.5 - E, 1), (.5, .8), (2, .6), (5, .3), (15, .1), (None, .5)]),
    "flood_risk": ("flood_zone", [("X", .9), (" x500_shaded ", .9), ("x500", .7), ("ae", .2), ("VE", 0), ("D", .5), (None, .5)]),
    "protected_area": ("protected_area_distance_km", [(1 - E, .3), (1, .7), (5, 1), (None, .5)]),
    "land_cover": ("elevation_m", [(5, .5), (None, .5)]),
}


def _frame(spark, rows):
    full = [tuple(r.get(n) for n in NAMES) for r in rows]
    return with_measurements(spark.createDataFrame(full, COLUMNS))


def _factor(key):
    return next(f for f in CATALOG if f.key == key)


@pytest.mark.parametrize("key", sorted(CASES))
def test_thresholds(spark, key):
    column, cases = CASES[key]
    rows = [{"lat": 10.0, "lon": 0.0, column: float(v) if isinstance(v, (int, float)) else v} for v, _ in cases]
    got = [r[0] for r in _frame(spark, rows).coalesce(1).select(_factor(key).score()).collect()]
    assert got == pytest.approx([w for _, w in cases], abs=1e-6)


def test_nan_counts_as_missing(spark):
    row = {"lat": 10.0, "lon": 0.0, **{c: math.nan for c, _ in CASES.values() if c != "flood_zone"}}
    scores = _frame(spark, [row]).select(*[f.score().alias(f.key) for f in CATALOG]).first().asDict()
    missing = _frame(spark, [{"lat": 10.0, "lon": 0.0}]).select(*[f.score().alias(f.key) for f in CATALOG]).first().asDict()
    assert scores == missing


def test_second_choice_measurements(spark):
    rows = [{"lat": 0.0, "precipitation_mm_day": 3.0}, {"lat": 0.0, "precipitation_mm_day": 0.1},
            {"lat": 0.0, "flood_probability": 0.2}, {"lat": 0.0, "in_protected_area": True, "protected_area_distance_km": 9.0},
            {"lat": 0.0, "in_protected_area": False}]
    df = _frame(spark, rows).coalesce(1)
    got = df.select(*[_factor(k).score().alias(k) for k in ("watershed_health", "flood_risk", "protected_area")]).collect()
    assert [got[0][0], got[1][0]] == [0.8, 0.2]
    assert got[2][1] == pytest.approx(0.8)
    assert [got[3][2], got[4][2]] == [0.0, 0.5]


@pytest.mark.parametrize("lat,ghi,wind", [(25.0, .85, .5), (25.1, .85, .5), (35.1, .7, .9), (55.0, .5, .9), (55.1, .3, .7), (-10.0, .85, .3)])
def test_latitude_fallbacks(spark, lat, ghi, wind):
    row = _frame(spark, [{"lat": lat}]).select(_factor("solar_irradiance").score(), _factor("wind_speed").score()).first()
    assert tuple(row) == (ghi, wind)


def test_each_type_has_ten_factors(spark):
    for t in TYPE_WEIGHTS:
        assert len(Scorecard.of(t).factors) == 10
        assert set(default_weights(t)) == set(Scorecard.of(t).weights)
    assert catalog_frame(spark).count() == 19
    sums = [round(sum(w.values()), 6) for w in TYPE_WEIGHTS.values()]
    assert sums == [11.9, 11.3, 11.2, 11.7]


def test_scorecard_rules():
    card = Scorecard.of("solar")
    with pytest.raises(KeyError):
        card.with_weight("Wind Speed", 1.0)
    with pytest.raises(KeyError):
        card.disable("nothing")
    with pytest.raises(ValueError):
        card.with_weight("Flood Risk", -1.0)
    with pytest.raises(ValueError):
        Scorecard.of("nuclear")
    with pytest.raises(KeyError):
        default_weights("nuclear")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert Scorecard.of("solar", {"Wind Speed": 9.0}).weights == card.weights
    assert caught


def test_score_invariants(spark):
    rows = [{"lat": float(i), "slope_degrees": float(i), "ghi_kwh_m2_day": i / 10, "flood_zone": "AE", "grid_distance_km": float(i)} for i in range(60)]
    df = _frame(spark, rows).coalesce(1)
    card = Scorecard.of("solar")
    base = [r[0] for r in score_sites(df, card).select("overall_score").collect()]
    assert all(0.0 <= s <= 1.0 for s in base)
    scaled = Scorecard.of("solar", {n: 7 * w for n, w in card.weights.items()})
    assert [r[0] for r in score_sites(df, scaled).select("overall_score").collect()] == pytest.approx(base)
    off = [r[0] for r in score_sites(df, card.disable("Flood Risk")).select("overall_score").collect()]
    zero = [r[0] for r in score_sites(df, card.with_weight("Flood Risk", 0.0)).select("overall_score").collect()]
    assert off == pytest.approx(zero)
    none = card
    for f in card.factors:
        none = none.disable(f.name)
    assert score_sites(df, none, detail=True).select("overall_score").first()[0] == 0.0


def test_detail_maps_and_split(spark):
    df = _frame(spark, [{"lat": 10.0, "slope_degrees": 3.0}])
    out = score_sites(df, Scorecard.of("hydro"), detail=True)
    real, guessed = split_measured(F.col("factor_scores"))
    row = out.select("factor_scores", "factor_weights", real.alias("r"), guessed.alias("g")).first()
    assert len(row["factor_scores"]) == len(row["factor_weights"]) == 10
    assert row["r"] == {"Terrain Slope": pytest.approx(0.8)} and len(row["g"]) == 9


def test_all_types_agree_with_single_scorecards(spark):
    df = _frame(spark, [{"lat": 40.0, "head_m": 30.0, "heat_flow_mwm2": 90.0}]).withColumn("site_id", F.lit(1))
    every = {r["energy_type"]: r["overall_score"] for r in score_all_types(df).collect()}
    for t, score in every.items():
        assert score == pytest.approx(score_sites(df, Scorecard.of(t)).first()["overall_score"])


def test_absent_columns_are_missing(spark):
    bare = spark.createDataFrame([(1, 30.0, 0.0)], "site_id int, lat double, lon double")
    out = score_sites(bare, Scorecard.of("solar"))
    assert out.columns == ["site_id", "lat", "lon", "overall_score", "energy_type"]
    full = score_sites(_frame(spark, [{"lat": 30.0}]), Scorecard.of("solar")).first()
    assert out.first()["overall_score"] == pytest.approx(full["overall_score"])


def test_user_factor_that_fails_is_left_out(spark):
    extra = Factor("x", "X", ("solar",), 2.0, lambda: F.when(F.col("lat") > 0, F.lit(9.0)))
    rows = [r for r in score_sites(_frame(spark, [{"lat": 30.0}, {"lat": -30.0}]).coalesce(1), Scorecard.of("solar", extra=[extra]), detail=True).collect()]
    plain = score_sites(_frame(spark, [{"lat": -30.0}]), Scorecard.of("solar")).first()["overall_score"]
    assert rows[0]["factor_scores"]["X"] == 1.0 and rows[1]["factor_scores"]["X"] == 0.0
    assert rows[1]["overall_score"] == pytest.approx(plain) and rows[0]["overall_score"] > plain


def test_combined_score(spark):
    row = spark.range(1).select(combined_score(F.lit(0.5), F.lit(1.0)), combined_score(F.lit(0.5), F.lit(None).cast("double"))).first()
    assert tuple(row) == (pytest.approx(0.8), 0.5)


def test_bands_do_not_hang_on_the_last_bit(spark):
    from sitegauge.functions.scalar import confidence_band, risk_gauge_band
    from pyspark.sql import functions as F
    rows = [(float(np.nextafter(b, 0.0)), float(np.nextafter(b, 1.0))) for b in (0.3, 0.4, 0.6, 0.7)]
    for r in spark.createDataFrame(rows, "a double, b double").select(
            *[f(F.col(c)).alias(f"{f.__name__}_{c}") for f in (confidence_band, risk_gauge_band) for c in "ab"]).collect():
        assert r[0] == r[1] and r[2] == r[3]
