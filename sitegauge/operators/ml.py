"""Model training and validation: boosted trees, perceptrons and logistic models of our own, MLlib for the rest.

Folds, groups, types and feature sets are models of one fit (``boosting.fit_many``, ``logistic.fit_many``, ``perceptron.fit_many``), so the number of jobs
does not follow their number. Driver loops here run over models, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import hash_order, hash_uniform
from sitegauge.operators import blocks, boosting, logistic, perceptron
from sitegauge.operators.dataset import stratified_folds, stratified_split
from sitegauge.operators.metrics import accuracy, rank_metrics
from sitegauge.operators.ranking import exact_rank, lookup
from sitegauge.session import durable


@dataclass(frozen=True)
class Settings:
    """Model sizes. The defaults are the published training configuration."""

    lr_iterations: int = 500
    trees: int = 300
    depth: int = 6
    learning_rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    hidden: tuple[int, ...] = (256, 128)
    mlp_iterations: int = 100
    seed: int = 42

    @property
    def boosting(self) -> boosting.Boosting:
        return boosting.Boosting(self.trees, self.depth, self.learning_rate, self.row_share, self.column_share, seed=self.seed)


def as_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def assemble_columns(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def scale_statistics(df: DataFrame, array: str) -> DataFrame:
    """Mean and population deviation of every dimension."""
    return df.select(F.posexplode(array).alias("dim", "x")).groupBy("dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))


def standard_scale(train: DataFrame, *others: DataFrame, features: str = "features") -> list[DataFrame]:
    """z-scores by population deviation, fitted on ``train``; constant dimensions become 0.

    MLlib divides by the sample deviation; sqrt(n / (n - 1)) turns one into the other.
    """
    model = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True).fit(train)
    n = train.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    corrected = array_to_vector(F.transform(vector_to_array("_scaled"), lambda x: x * F.lit(factor)))
    return [model.transform(df).withColumn(features, corrected).drop("_scaled") for df in (train, *others)]


def fit(train: DataFrame, kind: str, settings: Settings = Settings(), features: str = "features",
        label: str = "label", weight: str | None = None) -> Model:
    """Train ``logistic``, ``gbt`` or ``mlp``."""
    if kind == "logistic":
        # C = 1 on the sum of losses is 1/n on MLlib's mean of losses.
        n = max(1, train.count())
        lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / n, elasticNetParam=0.0,
                                standardization=False, maxIter=settings.lr_iterations)
        return (lr.setWeightCol(weight) if weight else lr).fit(train)
    if kind == "gbt":
        return boosting.fit_many(train, [boosting.Plan()], settings.boosting, features, label)[0]
    if kind == "mlp":
        return perceptron.fit_many(blocks.spread(train), [perceptron.Plan()], settings.hidden, settings.mlp_iterations, settings.seed, features, label,
                                   scale=False)[0]
    raise ValueError(f"unknown model {kind!r}")


def predict(model: Model, df: DataFrame, keep: Sequence[str], label: str = "label") -> DataFrame:
    """Metadata with y_true, y_prob and y_pred (probability of at least one half)."""
    prob = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(*keep, F.col(label).cast("int").alias("y_true"), prob.alias("y_prob")).withColumn(
        "y_pred", (F.col("y_prob") >= 0.5).cast("int"))


def evaluate(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision and accuracy; per group when ``by`` is given."""
    if by:
        return rank_metrics(predictions, by=by).join(accuracy(predictions, by=by), list(by))
    one = F.lit(1)
    return rank_metrics(predictions).withColumn("_one", one).join(
        accuracy(predictions).withColumn("_one", one), "_one").drop("_one")


def training_facts(model: Model, train: DataFrame, label: str = "label") -> DataFrame:
    """Rows trained on, and whether the fit has a lower log loss there than the constant share of positives."""
    y, q = F.col("y_true"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("y_prob")))
    share = F.avg(y.cast("double"))
    constant = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return predict(model, train, [], label).agg(
        F.count(F.lit(1)).alias("n_train"), (F.avg(-F.log(F.when(y == 1, q).otherwise(1 - q))) < constant).alias("beats_constant"))


def report(model: Model, train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``training_facts`` and the metrics of ``evaluate`` on the test rows."""
    one = F.lit(1)
    return evaluate(predict(model, test, [], label)).withColumn("_one", one).join(
        training_facts(model, train, label).withColumn("_one", one), "_one").drop("_one")


def train_and_report(df: DataFrame, key: str, kind: str, settings: Settings = Settings(), label: str = "label") -> DataFrame:
    """``report`` of one model on a stratified 80/20 split."""
    split = durable(stratified_split(df, label, key))
    train, test = standard_scale(split.filter(~F.col("is_test")), split.filter("is_test"))
    return report(fit(train, kind, settings, label=label), train, test, label)


def _tagged(df: DataFrame, **tags: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in tags.items()], "*")


def _layout(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, ...]]:
    """Places of every input column in the assembled vector; vector columns take several."""
    first = df.select(*columns).first()   # one row
    places, at = {}, 0
    for c in columns:
        width = len(first[c]) if first is not None and hasattr(first[c], "__len__") else 1
        places[c] = tuple(range(at, at + width))
        at += width
    return places


def ablation(df: DataFrame, key: str, feature_sets: Mapping[str, Sequence[str]], kinds: Sequence[str] = ("logistic", "gbt", "mlp"),
             settings: Settings = Settings(), label: str = "label") -> DataFrame:
    """Metrics of every (feature set, model) on one stratified 80/20 split. Sets share one fit of each kind."""
    every = list(dict.fromkeys(c for columns in feature_sets.values() for c in columns))
    wide = assemble_columns(stratified_split(df, label, key), every).withColumn("_part", F.col("is_test").cast("int"))
    split = durable(blocks.spread(wide.select(key, label, "is_test", "_part", "features")))
    places = _layout(df, every)
    used = [tuple(i for c in columns for i in places[c]) for columns in feature_sets.values()]
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    reports = None
    for kind in kinds:
        if kind == "gbt":
            models = boosting.fit_many(split, [boosting.Plan(u, frozenset({0})) for u in used], settings.boosting, label=label, part="_part")
        elif kind == "logistic":
            models = logistic.fit_many(split, [logistic.Plan(u, frozenset({0})) for u in used], label=label, part="_part", iterations=settings.lr_iterations)
        elif kind == "mlp":
            models = perceptron.fit_many(split, [perceptron.Plan(u, frozenset({0})) for u in used], settings.hidden, settings.mlp_iterations, settings.seed,
                                         label=label, part="_part")
        else:
            raise ValueError(f"unknown model {kind!r}")
        for name, model in zip(feature_sets, models):
            line = _tagged(report(model, train, test, label), features=name, model=kind)
            reports = line if reports is None else reports.unionByName(line)
    return reports


def ablation_deltas(report: DataFrame, both: str = "both") -> DataFrame:
    """Gain of the combined features over each single set, per model."""
    wide = report.filter(F.col("features") == both).select("model", F.col("auc_roc").alias("both_auc"))
    single = report.filter(F.col("features") != both).select("model", "features", "auc_roc")
    return single.join(wide, "model").select("model", F.col("features").alias("over"),
                                             (F.col("both_auc") - F.col("auc_roc")).alias("auc_delta"))


def fold_models(folds: DataFrame, kind: str, k: int, settings: Settings = Settings(), label: str = "label", weight: str | None = None,
                scale: bool = False) -> list:
    """A model for every value of ``fold`` below ``k``, trained on all other rows in one fit."""
    others = [frozenset(range(k)) - {fold} for fold in range(k)]
    if kind == "gbt":
        return boosting.fit_many(folds, [boosting.Plan(parts=o) for o in others], settings.boosting, label=label, part="fold")
    if kind == "logistic":
        return logistic.fit_many(folds, [logistic.Plan(parts=o) for o in others], label=label, part="fold", weight=weight,
                                 iterations=settings.lr_iterations, scale=scale)
    raise ValueError(f"no folds of {kind!r}")


def out_of_fold(folds: DataFrame, models: Sequence, keep: Sequence[str], label: str = "label") -> DataFrame:
    """Every row scored by the model that has not seen its fold."""
    if isinstance(models[0], logistic.Model):
        scored = logistic.scored_by_part(folds, models, "fold")
        return scored.select(*keep, F.col(label).cast("int").alias("y_true"), "y_prob")
    parts = [predict(m, folds.filter(F.col("fold") == i), keep, label) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, key: str, kind: str = "gbt", k: int = 5, settings: Settings = Settings(),
                   label: str = "label", weight: str | None = None, scale: bool = False) -> DataFrame:
    """AUC per stratified fold, and whether the fold's model has a lower log loss on its own rows than their share of positives.

    ``scale`` concerns logistic models only: trees look at the order of values.
    """
    folds = durable(blocks.spread(stratified_folds(df, label, key, k)))
    models = fold_models(folds, kind, k, settings, label, weight, scale)
    facts = reduce(DataFrame.unionByName, [training_facts(m, folds.filter(F.col("fold") != i), label).withColumn("fold", F.lit(i))
                                           for i, m in enumerate(models)])
    return rank_metrics(out_of_fold(folds, models, [key, "fold"], label), by=["fold"]).join(facts, "fold").select(
        "fold", "n_pos", "n_neg", "auc_roc", "n_train", "beats_constant")


def usable_folds(df: DataFrame, k: int = 5, label: str = "label") -> int:
    """``k``, but no more folds than the smaller class has rows."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return max(2, min(k, smallest))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("auc_roc").alias("mean_auc"), F.stddev_pop("auc_roc").alias("std_auc"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 n_class) per row; the class sizes are one row each."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all")).withColumn("_one", F.lit(1))
    table = sizes.withColumn("_one", F.lit(1)).join(total, "_one").select(
        label, (F.col("_all") / (2.0 * F.col("_n"))).alias("weight"))
    return df.join(lookup(table), label)


def leave_one_out(df: DataFrame, group: str, values: Sequence[str], key: str, settings: Settings = Settings(), label: str = "label") -> DataFrame:
    """AUC of each held-out group with a logistic model trained on all other groups; ``slope`` is what is left of the gradient."""
    if not values:
        raise ValueError("no group to hold out")
    # Groups that are never held out are part -1: all models see them. Rows without a group are seen by none.
    numbered = durable(df.withColumn("_part", (F.array_position(F.lit(list(values)), F.col(group)) - 1).cast("int")))
    every = frozenset(range(-1, len(values)))
    models = logistic.fit_many(numbered, [logistic.Plan(parts=every - {i}) for i in range(len(values))], label=label, part="_part",
                               iterations=settings.lr_iterations)
    held_out = logistic.scored_by_part(numbered, models, "_part").select(group, F.col(label).cast("int").alias("y_true"), "y_prob")
    # One row for each group held out.
    slopes = df.sparkSession.createDataFrame([(v, m.gradient) for v, m in zip(values, models)], f"`{group}` string, slope double")
    return rank_metrics(held_out, by=[group]).join(F.broadcast(slopes), group)


def train_and_score(df: DataFrame, key: str, kind: str, keep: Sequence[str] = (), settings: Settings = Settings(),
                    label: str = "label") -> DataFrame:
    """Predictions for the test fifth of a stratified split."""
    split = durable(stratified_split(df, label, key))
    train, test = standard_scale(split.filter(~F.col("is_test")), split.filter("is_test"))
    return predict(fit(train, kind, settings, label=label), test, [key, *keep], label)


def feature_importance(model: Model, names: Sequence[str], df: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features of a tree model (one row per feature, not per sample)."""
    spark = df.sparkSession
    rows = [(names[i], float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature").limit(n)


def shuffle_labels(df: DataFrame, key: str, label: str = "label", seed: object = "shuffle") -> DataFrame:
    """Random permutation of the labels, by two exact ranks in different orders."""
    here = exact_rank(df.drop(label), [], [key], "_rank")
    there = exact_rank(df.select(label, F.col(key).alias("_k")).withColumn("_u", hash_order(F.col("_k"), seed)),
                       [], ["_u", "_k"], "_rank").select("_rank", label)
    return here.join(there, "_rank").drop("_rank")


def learning_curve(df: DataFrame, key: str, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0),
                   settings: Settings = Settings(), label: str = "label") -> DataFrame:
    """``report`` of logistic models against the share of training rows used (nested random subsets)."""
    split = stratified_split(df, label, key)
    u = hash_uniform(F.col(key), "curve")
    # A row belongs to the smallest share that holds it, and to all larger ones.
    place = F.size(F.filter(F.lit(sorted(shares)), lambda s: s <= u))
    placed = durable(split.withColumn("_part", F.when(F.col("is_test"), F.lit(-1)).otherwise(place)))
    models = logistic.fit_many(placed, [logistic.Plan(parts=frozenset(range(i + 1))) for i in range(len(shares))], label=label, part="_part",
                               iterations=settings.lr_iterations)
    lines = [report(m, placed.filter(F.col("_part").between(0, i)), placed.filter("is_test"), label).withColumn("share", F.lit(s))
             for i, (s, m) in enumerate(zip(sorted(shares), models))]
    return reduce(DataFrame.unionByName, lines)


def pca_variance(df: DataFrame, k: int = 50, features: str = "features") -> DataFrame:
    """Share of variance of the leading components, with the running total."""
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(df)
    total, rows = 0.0, []
    for i, v in enumerate(model.explainedVariance.toArray(), start=1):
        total += float(v)
        rows.append((i, float(v), total))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double")


def per_type_baseline(df: DataFrame, key: str, types: Sequence[str], columns: Callable[[Column, Column], list[Column]],
                      settings: Settings = Settings(), label: str = "label", min_rows: int = 100,
                      suspicious: float = 0.95) -> DataFrame:
    """Location-only model per energy type; a very high AUC is flagged as suspicious.

    Types with fewer than ``min_rows`` rows are left out.
    """
    sizes = {r[0]: r[1] for r in df.filter(F.col("energy_type").isin(*types)).groupBy("energy_type").count().collect()}
    kept = [t for t in types if sizes.get(t, 0) >= min_rows]
    if not kept:
        raise ValueError(f"no type has {min_rows} rows")
    part = df.filter(F.col("energy_type").isin(*kept)).withColumn("_stratum", F.concat_ws("/", "energy_type", label))
    feats = F.array(*[c.cast("double") for c in columns(F.col("lat"), F.col("lon"))])
    number = F.array_position(F.lit(kept), F.col("energy_type")).cast("int") - 1
    ready = part.select(key, "energy_type", label, "_stratum", feats.alias("features"), number.alias("_type"))
    split = durable(stratified_split(ready, "_stratum", key).withColumn("_part", F.when(F.col("is_test"), F.lit(-1)).otherwise(F.col("_type"))))
    models = logistic.fit_many(split, [logistic.Plan(parts=frozenset({i})) for i in range(len(kept))], label=label, part="_part",
                               iterations=settings.lr_iterations)
    scored = logistic.scored_by_part(split.filter("is_test"), models, "_type").select("energy_type", F.col(label).cast("int").alias("y_true"), "y_prob")
    # One row for each type.
    slopes = df.sparkSession.createDataFrame([(t, m.gradient) for t, m in zip(kept, models)], "energy_type string, slope double")
    return rank_metrics(scored, by=["energy_type"]).withColumn("suspicious", F.col("auc_roc") > suspicious).join(F.broadcast(slopes), "energy_type")
