"""Samples that must reach their size, cuts of ordered groups, and rows that must not get lost."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import dataset, features, ml, spatial
from sitegauge.operators.ranking import first_in_order


@pytest.mark.parametrize("shift", [0, 3, 40])
def test_first_in_order(spark, shift):
    rng = np.random.default_rng(shift)
    rows = [(g, int(p), i) for i, (g, p) in enumerate(zip(rng.choice(["a", "b", "c"], 300, p=[.6, .3, .1]), rng.integers(0, 40, 300)))]
    goals = {"a": 100, "b": 1000, "c": 0}
    df = spark.createDataFrame([(str(g), p, i, "x") for g, p, i in rows], "g string, p long, id long, _goal string")
    goal = F.create_map(*[F.lit(x) for pair in goals.items() for x in pair])[F.col("g")]
    got = {r["id"] for r in first_in_order(df, "g", F.col("p"), "id", goal, shift).collect()}
    assert got == {i for g in goals for _, i in sorted((p, i) for h, p, i in rows if h == g)[:goals[g]]}
    assert first_in_order(df.limit(0), "g", F.col("p"), "id", goal, shift).count() == 0


def test_cut_has_no_window_over_a_group(spark, sf_dir):
    df = spark.range(100).select(F.lit("a").alias("g"), "id")
    plan = first_in_order(df, "g", F.col("id"), "id", F.lit(50), 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One over counts of buckets, one inside a bucket.
    assert len(windows) == 2 and "sum(_c" in windows[1] and "_b#" in windows[0].split("], [")[1]


def _occupied(spark, free):
    """Positives in every third row and column of cells of a one-degree box, which blocks all its cells but those west of ``free``."""
    ids = spark.range(9 * 9)
    return ids.select((F.floor(F.col("id") / 9) * 0.15 + 10.075 - 0.05).alias("lat"), ((F.col("id") % 9) * 0.15 + 10.075 - 0.05).alias("lon"),
                      F.lit("wind").alias("energy_type")).filter(F.col("lon") > free)


def test_negatives_reach_their_number_where_most_is_occupied(spark, monkeypatch):
    """Candidates of a one-degree box, nine tenths of which are occupied."""
    everywhere = dataset.candidate_points
    monkeypatch.setattr(dataset, "candidate_points", lambda *a, **k: everywhere(*a, **k).select(
        "candidate", (F.lit(10.0) + (F.col("lat") + 90.0) / 180.0).alias("lat"), (F.lit(10.0) + (F.col("lon") + 180.0) / 360.0).alias("lon"), "u"))
    got = dataset.negatives_by_type(_occupied(spark, 10.2), {"wind": 60}, style="spaced").collect()
    assert len(got) == 60 and max(r["lon"] for r in got) < 10.3
    more = dataset.negatives_by_type(_occupied(spark, 10.2), {"wind": 60}, style="spaced", draws=100).collect()
    assert sorted(r["candidate"] for r in got) == sorted(r["candidate"] for r in more)
    with pytest.raises(ValueError, match="only 0 of 60 negatives for wind after 3 batches"):
        dataset.negatives_by_type(_occupied(spark, 9.0), {"wind": 60}, style="spaced", max_batches=3)


def test_nearest_feature_keeps_every_site(spark):
    sites = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 200.0), (3, None, 5.0), (4, 95.0, 5.0)], "id long, lat double, lon double")
    points = spark.createDataFrame([(7, 11.0, 10.0), (8, 10.0, 1e9), (9, None, None)], "pid long, lat double, lon double")
    got = {r["id"]: r["nearest_id"] for r in spatial.nearest_feature(sites, points, "id", "pid").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}
    assert {r["nearest_id"] for r in spatial.nearest_feature(sites, points.limit(0), "id", "pid").collect()} == {None}


def test_discharge_of_the_last_year_only(spark):
    day = lambda y, m, d: datetime.datetime(y, m, d)
    rows = [(1, day(2020, 6, 1), 100.0), (1, day(2024, 6, 1), 10.0), (1, day(2024, 5, 1), -5.0), (1, day(2024, 6, 2), 90.0), (2, day(2023, 6, 3), 7.0), (2, day(2023, 6, 2), 70.0)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, discharge double")
    got = {r["site_id"]: r["discharge_m3s"] for r in features.discharge_features(df, F.lit("2024-06-01").cast("timestamp_ntz")).collect()}
    assert got == {1: 10.0, 2: 7.0}


def test_training_facts(spark):
    rows = [(i, [float(i % 2), float(i % 7)], i % 2) for i in range(60)]
    df = ml.as_vector(spark.createDataFrame(rows, "id long, x array<double>, label int"), "x")
    good = ml.train_and_report(df, "id", "logistic").first()
    assert good["n_train"] == 48 and (good["n_pos"], good["n_neg"]) == (6, 6) and good["beats_constant"] and good["auc_roc"] == 1.0
    model = ml.fit(df, "logistic", ml.Settings(lr_iterations=0))
    assert not ml.training_facts(model, df).first()["beats_constant"]
