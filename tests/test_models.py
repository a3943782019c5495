"""Boosted trees and logistic models against plain numpy versions on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import blocks, boosting, logistic, ml, perceptron

SMALL = boosting.Boosting(trees=12, depth=3, bins=8)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 6)), 3)
    x[:, 4] = 1.0
    x[:40] = x[40:80]     # repeated rows
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    y[::17] = 1 - y[::17]
    return x, y, np.arange(400) % 4


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, part = data
    rows = [(i, a.tolist(), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, part))]
    rows += [(900, None, 1.0, 0), (901, x[0].tolist(), None, 0), (902, x[0].tolist(), 1.0, None)]   # never trained on
    return spark.createDataFrame(rows, "id int, features array<double>, label double, part int").repartition(5).cache()


def grown(x, y, keys, use, columns, settings, trees):
    """Exact greedy trees over bins, one node at a time, without histograms of siblings."""
    margin, out = np.zeros(len(y)), []
    for number in range(trees):
        plan = boosting.Plan(columns)
        cols = boosting.drawn_columns(plan, x.shape[1], number, settings)
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        drawn = use & (boosting.mixed(keys, settings.seed * 1_000_003 + number) < settings.row_share)
        value = np.zeros(len(y))

        def walk(rows, everyone, depth):
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-12, None, None)
            if depth < settings.depth:
                for c in cols:
                    for b in range(settings.bins - 1):
                        left = rows[x[rows, c] <= b]
                        lg, lh = g[left].sum(), h[left].sum()
                        if lh < settings.least_hessian or sh - lh < settings.least_hessian:
                            continue
                        gain = 0.5 * (lg ** 2 / (lh + settings.l2) + (sg - lg) ** 2 / (sh - lh + settings.l2) - sg ** 2 / (sh + settings.l2))
                        if gain > best[0] + 1e-9:
                            best = (gain, c, b)
            if best[1] is None:
                value[everyone] = -settings.rate * sg / (sh + settings.l2)
                return
            _, c, b = best
            walk(rows[x[rows, c] <= b], everyone[x[everyone, c] <= b], depth + 1)
            walk(rows[x[rows, c] > b], everyone[x[everyone, c] > b], depth + 1)
        walk(np.flatnonzero(drawn), np.arange(len(y)), 0)
        margin = margin + value
        out.append(margin)
    return out[-1]


def test_boosting_equals_plain_trees(spark, table, data):
    x, y, part = data
    plans = [boosting.Plan(), boosting.Plan(columns=(0, 1, 4)), boosting.Plan(parts=frozenset({0, 1, 3}))]
    models = boosting.fit_many(table, plans, SMALL, part="part")
    rows = table.filter("features IS NOT NULL AND label IS NOT NULL AND part IS NOT NULL").select(
        "id", F.xxhash64("features", "label", "part").alias("key")).collect()
    key_of = {r["id"]: r["key"] for r in rows}
    keys = np.array([key_of[i] for i in range(400)], np.int64)
    binned = boosting.bin_rows(x, models[0].edges)
    for plan, model in zip(plans, models):
        use = np.isin(part, list(plan.parts)) if plan.parts else np.ones(400, bool)
        want = grown(binned, y, keys, use, plan.columns, SMALL, SMALL.trees)
        assert np.allclose(model.margins(x), want, atol=1e-9)
        if plan.columns:
            assert {f for t in model.trees for f in t.feature if f >= 0} <= set(plan.columns)


def test_boosting_learns_and_predicts_in_spark(table, data):
    x, y, _ = data
    model = ml.fit(table, "gbt", ml.Settings(trees=60, depth=4))
    got = {r["id"]: r["y_prob"] for r in ml.predict(model, table.filter("id < 400"), ["id"]).collect()}
    want = 1 / (1 + np.exp(-model.margins(x)))
    assert np.allclose([got[i] for i in range(400)], want)
    assert ((want >= 0.5) == (y == 1)).mean() > 0.9
    importance = model.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and set(np.argsort(-importance)[:2]) == {0, 1} and importance[4] == 0


def test_boosting_of_one_class_and_of_nothing(spark, table):
    one = boosting.fit_many(table.withColumn("label", F.lit(1.0)), [boosting.Plan()], boosting.Boosting(trees=3))[0]
    assert (one.margins(np.zeros((1, 6))) > 0).all()
    none = boosting.fit_many(table.filter("false"), [boosting.Plan()], boosting.Boosting(trees=3))[0]
    assert none.margins(np.zeros((2, 0))).tolist() == [0, 0]
    with pytest.raises(ValueError):
        boosting.fit_many(table, [boosting.Plan(columns=())])


def test_sums_do_not_depend_on_partitions(table, monkeypatch):
    plans = [logistic.Plan()]
    want = logistic.fit_many(table, plans)[0]
    small = boosting.Boosting(trees=3, depth=4)
    alone = boosting.fit_many(table, [boosting.Plan()], small)[0]
    monkeypatch.setattr(blocks, "PARTITION_ROWS", 50)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 17)
    monkeypatch.setattr(blocks, "FAN_IN", 2)
    got = logistic.fit_many(table, plans)[0]
    assert np.allclose(got.weights, want.weights, atol=1e-9)
    several = boosting.fit_many(table, [boosting.Plan()], small)[0]
    assert all((s.feature == t.feature).all() and (s.last == t.last).all() for s, t in zip(alone.trees, several.trees))


def test_many_logistic_models_equal_single_fits(table, data):
    x, y, part = data
    plans = [logistic.Plan(parts=frozenset({0, 1, 2, 3}) - {k}) for k in range(4)] + [logistic.Plan(columns=(1, 3))]
    models = logistic.fit_many(table, plans, part="part")
    for plan, model in zip(plans, models):
        use = np.isin(part, list(plan.parts)) if plan.parts else np.ones(400, bool)
        cols = list(plan.columns or range(6))
        sd = x[use].std(axis=0)
        z = np.where(sd > 1e-12, (x[use] - x[use].mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0)[:, cols]
        z = np.hstack([z, np.ones((len(z), 1))])
        w = np.zeros(z.shape[1])
        keep = np.append(np.ones(len(cols)), 0)
        for _ in range(50):   # plain Newton
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep), z.T @ (p - y[use]) + keep * w)
        want = np.zeros(6)
        want[cols] = w[:-1] / np.where(sd[cols] > 1e-12, sd[cols], np.inf)
        assert np.allclose(model.weights, want, atol=1e-6) and model.gradient < 1e-5
        assert model.intercept == pytest.approx(w[-1] - (want * x[use].mean(axis=0)).sum(), abs=1e-6)


def test_logistic_equals_mllib(table):
    clean = ml.as_vector(table.filter("features IS NOT NULL AND label IS NOT NULL"), "features")
    scaled = ml.standard_scale(clean)[0]
    one = ml.fit(scaled, "logistic")
    ours = logistic.fit_many(scaled, [logistic.Plan()], scale=False)[0]
    assert np.allclose(one.coefficients.toArray(), ours.weights, atol=1e-4)


def test_jobs_do_not_follow_the_models(spark, table):
    def jobs(n: int) -> int:
        spark.sparkContext.setJobGroup(f"models-{n}", "")
        logistic.fit_many(table, [logistic.Plan(parts=frozenset({0, 1, 2, 3}) - {k % 4}) for k in range(n)], part="part")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"models-{n}"))
    assert jobs(12) == jobs(4)


def test_folds_and_groups(table):
    rows = table.filter("id < 400").withColumn("group", F.concat(F.lit("g"), "part"))
    folds = {r["fold"]: r for r in ml.cross_validate(rows, "id", "gbt", 4, ml.Settings(trees=40, depth=3)).collect()}
    assert set(folds) == {0, 1, 2, 3} and all(r["auc_roc"] > 0.8 and r["beats_constant"] for r in folds.values())
    left_out = ml.leave_one_out(rows, "group", ["g0", "g2"], "id").collect()
    assert {r["group"] for r in left_out} == {"g0", "g2"} and all(r["n_pos"] + r["n_neg"] == 100 and r["slope"] < 1e-5 for r in left_out)


def _jobs(spark, group, run) -> int:
    spark.sparkContext.setJobGroup(group, "")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_trees_that_fit_a_task_take_no_job_each(spark, table):
    """Job numbers follow neither the trees nor the models; the way over many tasks grows the same trees."""
    def fit(trees: int, plans: int):
        return boosting.fit_many(table, [boosting.Plan(parts=frozenset({0, 1, 2, 3}) - {k}) for k in range(plans)],
                                 boosting.Boosting(trees=trees, depth=3, bins=8), part="part")
    assert _jobs(spark, "trees-3", lambda: fit(3, 2)) == _jobs(spark, "trees-12", lambda: fit(12, 4))


def test_trees_in_one_task_and_in_many(table, data, monkeypatch):
    plans = [boosting.Plan(), boosting.Plan((0, 1, 4), frozenset({0, 1, 3})), boosting.Plan(parts=frozenset({9}))]
    small = boosting.Boosting(trees=4, depth=4)
    alone = boosting.fit_many(table, plans, small, part="part")
    monkeypatch.setattr(boosting, "TASK_CELLS", 0)
    monkeypatch.setattr(blocks, "PARTITION_ROWS", 50)
    many = boosting.fit_many(table, plans, small, part="part")
    for one, other in zip(alone, many):
        assert len(one.trees) == len(other.trees) == 4
        assert all((s.feature == t.feature).all() and (s.last == t.last).all() for s, t in zip(one.trees, other.trees))
        assert np.allclose(one.margins(data[0]), other.margins(data[0]), atol=1e-9)
    assert not alone[2].margins(data[0]).any()   # no rows


def test_perceptron_gradient():
    rng = np.random.default_rng(1)
    z, y, sizes = rng.normal(size=(30, 3)), (rng.random(30) > 0.4).astype(float), (3, 5, 4, 2)
    point = perceptron.first_point(sizes, 7)
    slope = perceptron.loss_and_gradient(point, sizes, z, y)[1]
    for i, unit in enumerate(np.eye(len(point)) * 1e-6):
        up, down = (perceptron.loss_and_gradient(point + s * unit, sizes, z, y)[0] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(slope[i], abs=1e-6)


def test_perceptrons_share_passes_and_equal_single_fits(spark, table, data):
    x, y, part = data
    plans = [perceptron.Plan(), perceptron.Plan((0, 1)), perceptron.Plan(parts=frozenset({0, 1, 3})), perceptron.Plan(parts=frozenset({9}))]
    models = perceptron.fit_many(table, plans, (6, 4), 10, part="part")
    for plan, model in zip(plans[:3], models):
        use = np.isin(part, list(plan.parts)) if plan.parts else np.ones(400, bool)
        alone = perceptron.fit_many(table.filter(F.col("part").isin(*(plan.parts or {0, 1, 2, 3}))), [perceptron.Plan(plan.columns)], (6, 4), 10)[0]
        assert np.allclose(alone.mean, x[use][:, model.columns].mean(axis=0)) and np.allclose(alone.probabilities(x), model.probabilities(x), atol=1e-4)
    assert np.allclose(models[3].point, perceptron.first_point(models[3].sizes, 42))   # no rows
    got = {r["id"]: r["y_prob"] for r in ml.predict(models[0], table.filter("id < 400"), ["id"]).collect()}
    assert np.allclose([got[i] for i in range(400)], models[0].probabilities(x))


def test_perceptron_is_as_good_as_mllib(table):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    clean = ml.as_vector(table.filter("features IS NOT NULL AND label IS NOT NULL"), "features")
    scaled = ml.standard_scale(clean)[0].cache()
    theirs = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[6, 6, 4, 2], maxIter=60, seed=42).fit(scaled)
    ours = perceptron.fit_many(scaled, [perceptron.Plan()], (6, 4), 60, scale=False)[0]

    def loss(model):
        return sum(-np.log(r["y_prob"] if r["y_true"] else 1 - r["y_prob"]) for r in ml.predict(model, scaled, []).collect())
    assert loss(ours) < 1.1 * loss(theirs)


def test_ablation_shares_the_fit_of_perceptrons(spark, table):
    rows = table.filter("id < 400").select("id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(4)])
    few = ml.Settings(hidden=(4,), mlp_iterations=3)

    def run(sets):
        return lambda: ml.ablation(rows, "id", sets, ["mlp"], few)
    one = _jobs(spark, "one-set", run({"a": ["f0", "f1"]}))
    three = _jobs(spark, "three-sets", run({"a": ["f0", "f1"], "b": ["f2", "f3"], "both": ["f0", "f1", "f2", "f3"]}))
    assert three < 1.5 * one


def test_rows_are_spread_before_a_fit(spark):
    assert blocks.spread(spark.range(1000).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
