"""Smaller operators on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import scalar
from sitegauge.operators import climate, dataset, features, imagery, labels, metrics, ml, reports
from sitegauge.sources import eia, osm, tables


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_capacity_text(spark):
    texts = ["5 MW", "7.5mw", "1.2.3 MW", "yes", "~500 kW", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(scalar.capacity_number(F.col("t"))).collect()]
    assert got == [5.0, 7.5, None, None, 500.0, None, None]


def test_tag_classes(spark):
    rows = [({"source": "Hydro;Solar"},), ({"generator:source": "x; Wind"},), ({"plant:source": "coal", "generator:source": "tidal"},), ({"name": "a"},)]
    got = [r[0] for r in spark.createDataFrame(rows, "t map<string,string>").coalesce(1).select(osm.classify_tags(F.col("t"))).collect()]
    assert [tuple(g) if g else None for g in got] == [
        (6, "hydro", "source=hydro;solar"), (2, "wind", "generator:source=wind"), (4, "coal", "plant:source=coal"), None]


def test_fuel_maps():
    assert (len(eia.fuel_map()), len(eia.fuel_map("global")), len(eia.fuel_map("renewable"))) == (22, 17, 4)


def test_regions(spark):
    lat, lon = F.lit(35.7), F.lit(139.7)
    assert _one(spark, scalar.region_rules(lat, lon), scalar.region_rules_negative(lat, lon), scalar.region_boxes(lat, lon)) == ("Oceania", "Asia", "East Asia")


def test_year(spark):
    df = spark.createDataFrame([("2020",), ("20201",), ("",), (None,), ("abcd",)], "y string").coalesce(1)
    assert [r[0] for r in df.select(scalar.year4(F.col("y"))).collect()] == [2020, None, None, None, None]


def test_interpolation_knots(spark):
    years = [2000, 2030, 2040, 2050, 2060, 2100, 2150]
    got = _one(spark, *[climate.interpolate(F.lit("SSP585"), F.lit(y), "temperature") for y in years])
    assert got == pytest.approx((0.8, 0.8, 1.35, 1.9, 2.5, 4.4, 4.4))


def test_climate_without_measurements(spark):
    cols = ", ".join(f"{c} double" for c in climate.DEFAULTS)
    df = spark.createDataFrame([(1, 60.0, *[None] * 5)], f"site_id bigint, lat double, {cols}")
    row = climate.assess(df, F.lit("nonsense"), F.lit(2050)).first()
    assert row["scenario"] == "SSP245" and row["confidence"] == 0.5
    assert row["extreme_event_probs"]["tropical_cyclone"] == 0.0
    assert row["solar_ghi_kwh_m2_year"]["p50"] == round(4.5 * 365 * (1 - 0.005 * 1.4))


def test_auc_edge_cases(spark):
    def auc(rows):
        return metrics.rank_metrics(spark.createDataFrame(rows, "y_prob double, y_true int")).first()
    assert auc([(0.5, 1), (0.5, 0)])["auc_roc"] == 0.5
    assert auc([(0.9, 1), (0.1, 0)])["auc_roc"] == 1.0
    only = auc([(0.9, 1), (0.1, 1)])
    assert (only["auc_roc"], only["average_precision"]) == (0.0, 1.0)
    assert auc([(0.9, 0)])["average_precision"] == 0.0


def test_at_k_skips_large_k(spark):
    df = spark.range(60).select("id", (F.col("id") / 60).alias("y_prob"), (F.col("id") >= 30).cast("int").alias("y_true"))
    got = {r["k"]: r for r in metrics.at_k(df, "id").collect()}
    assert set(got) == {50}
    assert got[50]["precision_at_k"] == pytest.approx(0.6) and got[50]["recall_at_k"] == 1.0


def test_calibration_edge_goes_down(spark):
    df = spark.createDataFrame([(0.2, 1), (0.2000001, 0), (1.0, 1)], "y_prob double, y_true int")
    assert {r["bin"]: r["n"] for r in metrics.calibration(df).collect()} == {0: 1, 1: 1, 4: 1}


def test_exact_split_and_folds(spark):
    df = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    sizes = {tuple(r)[:2]: r["count"] for r in dataset.stratified_split(df, "label", "id").groupBy("label", "is_test").count().collect()}
    assert sizes[(1, True)] == 50 and sizes[(0, True)] == 150
    folds = [r["count"] for r in dataset.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()]
    assert max(folds) - min(folds) <= 102 and sum(folds) == 1003 and len(folds) == 10


def test_sampling_uses_every_row_when_short(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit("solar").alias("energy_type"))
    assert dataset.sample_positives(df, {"solar": 500}, "id").count() == 100
    for cells in ("round", "trunc"):
        assert dataset.sample_positives(df, {"solar": 40}, "id", cells).count() == 40


def test_negatives_keep_their_distance(spark):
    occupied = spark.range(2000).select(((F.col("id") % 100) - 50).cast("double").alias("lat"), (F.col("id") % 300 - 150).cast("double").alias("lon"), F.lit("wind").alias("energy_type"))
    got = dataset.negatives_by_type(occupied, {"wind": 50}, {"wind": 400}).collect()
    assert len(got) == 50
    cells = {(math.floor(r["lat"] / 0.05), math.floor(r["lon"] / 0.05)) for r in occupied.collect()}
    for r in got:
        cy, cx = math.floor(r["lat"] / 0.05), math.floor(r["lon"] / 0.05)
        assert not any((cy + a, cx + b) in cells for a in (-1, 0, 1) for b in (-1, 0, 1))


def test_merge_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0, "solar", "f", "n", 5.0, "US", "2001")], "loc_id bigint, lat double, lon double, energy_type string, source string, name string, capacity_mw double, country_code string, operating_year string")
    out = dataset.merge_sources(a, a.drop("capacity_mw", "name").withColumn("loc_id", F.lit(2)))
    row = out.filter("loc_id = 2").first()
    assert (row["capacity_mw"], row["name"], row["source_rank"]) == (0.0, "", 1)


def test_slope_of_a_plane(spark):
    rows = [(1, 0.0, p, e) for p, e in (("C", 100.0), ("N", 100.0), ("S", 100.0), ("E", 100.0 + 556.6), ("W", 100.0 - 556.6))]
    rows += [(2, 0.0, "C", 5.0)]
    out = {r["site_id"]: r for r in features.terrain_features(spark.createDataFrame(rows, "site_id bigint, lat double, position string, elevation double")).collect()}
    assert out[1]["slope_degrees"] == pytest.approx(45.0) and out[1]["head_m"] == pytest.approx(1113.2)
    assert out[2]["elevation_m"] is None


def test_constant_wind_is_consistent(spark):
    df = spark.createDataFrame([(1, 5.0, 90.0), (1, 7.0, 90.0), (2, 5.0, 0.0), (2, 5.0, 180.0), (3, 0.0, 0.0)], "site_id bigint, speed double, direction_deg double")
    out = {r[0]: r[1] for r in features.direction_consistency(df).collect()}
    assert out[1] == pytest.approx(1.0) and out[2] == pytest.approx(0.0, abs=1e-12) and out[3] is None


def test_crop_and_pad(spark):
    big = spark.range(36).select(F.lit(1).alias("patch_id"), F.lit("B01").alias("band"), (F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    got = {(r["row"], r["col"]): r["value"] for r in imagery.crop_pad(big, 4).collect()}
    assert len(got) == 16 and got[(0, 0)] == 7.0 and got[(3, 3)] == 28.0
    small = big.filter("row < 2")
    got = {(r["row"], r["col"]): r["value"] for r in imagery.crop_pad(small, 4).collect()}
    assert len(got) == 16 and got[(0, 0)] == 0.0 and got[(1, 3)] == 9.0 and got[(3, 3)] == 0.0


def test_fill_of_a_square_and_a_concave_ring(spark):
    def fill(points):
        ring = [(float(x), float(y)) for x, y in points]
        df = spark.createDataFrame([(1, 1, 3, ring, 0.0, 0.0, 10.0, 10.0, 10, 10)],
                                   "window_id int, osm_id int, class_id int, ring array<struct<x: double, y: double>>, wxmin double, wymin double, wxmax double, wymax double, width int, height int")
        got = [(r["row"], r["col"]) for r in labels.scanline_fill(df).collect()]
        assert len(got) == len(set(got))
        return set(got)
    assert fill([(2, 2), (5, 2), (5, 4), (2, 4), (2, 2)]) == {(r, c) for r in (6, 7) for c in range(2, 6)}
    notch = fill([(0, 0), (9, 0), (9, 9), (5, 1), (4, 1), (0, 9), (0, 0)])
    assert (2, 0) in notch and (2, 8) in notch and (2, 5) not in notch
    assert fill([(20, 20), (30, 20), (30, 30), (20, 20)]) == set()


def test_utm_of_known_points(spark):
    got = spark.range(1).select(labels.to_utm(F.lit(0.0), F.lit(3.0), F.lit(31)).alias("a"), labels.to_utm(F.lit(-45.0), F.lit(3.0), F.lit(31)).alias("b")).first()
    assert tuple(got["a"]) == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    assert got["b"]["y"] == pytest.approx(10_000_000 - 0.9996 * 4984944.378, abs=0.01)


def test_quality_of_clean_data(spark):
    rows = [(float(i), float(i), t, i % 2, "Asia" if i % 3 else "Europe") for i in range(40) for t in scalar.ENERGY_TYPES]
    checks = reports.data_quality(spark.createDataFrame(rows, "lat double, lon double, energy_type string, label int, region string"))
    assert {r["check"]: r["passed"] for r in checks.collect()} == {c: True for c in [r["check"] for r in checks.collect()]}
    assert checks.count() == 15
    assert tuple(reports.pass_rate(checks).first()) == (15, 15)


def test_report_json_has_no_nan(spark):
    out = tables.report_json(spark.createDataFrame([("a", float("nan"))], "k string, v double"), []).first()["value"]
    assert out == '{"k":"a","v":null}'


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "/nowhere/x.csv")


def test_standard_scale_uses_population_deviation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (40, 3))
    x[:, 2] = 1.0
    df = ml.as_vector(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, a array<double>"), "a")
    got = np.array([r["features"].toArray() for r in ml.standard_scale(df)[0].orderBy("id").collect()])
    want = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    assert got == pytest.approx(want, abs=1e-9)


def test_logistic_separates_and_shuffled_labels_keep_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(v + (i % 2)) for v in rng.normal(0, 0.5, 4)]) for i in range(200)]
    df = ml.as_vector(spark.createDataFrame(rows, "id bigint, label int, a array<double>"), "a").drop("a")
    report = ml.evaluate(ml.train_and_score(df, "id", "logistic", settings=ml.Settings(lr_iterations=20))).first()
    assert report["auc_roc"] > 0.9 and report["n_pos"] + report["n_neg"] == 40
    shuffled = ml.shuffle_labels(df, "id")
    assert shuffled.agg(F.sum("label"), F.count("label")).first()[:] == (100, 200)
    assert ml.usable_folds(df, 5) == 5


def test_tiles_are_cropped_like_pixels(spark):
    from sitegauge.operators import imagery
    tiles = spark.createDataFrame([(i, "B02", h, w, [None if j == 3 else float("nan") if j == 4 else float(j + 1) for j in range(h * w)])
                                   for i, (h, w) in enumerate([(9, 7), (4, 4), (3, 8), (8, 2), (1, 1), (6, 5)])],
                                  "patch_id int, band string, h int, w int, values array<double>")
    pixels = tiles.select("patch_id", "band", "w", F.posexplode("values").alias("i", "value")).select(
        "patch_id", "band", F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).alias("col"), "value")
    want = {(r["patch_id"], r["row"] * 4 + r["col"]): r["value"] for r in imagery.crop_pad(pixels, 4).collect()}
    cropped = imagery.crop_pad_tiles(tiles, 4)
    assert {(r["patch_id"], i): v for r in cropped.collect() for i, v in enumerate(r["values"])} == want and len(want) == 6 * 16
    assert "Exchange" not in cropped._jdf.queryExecution().executedPlan().toString()
