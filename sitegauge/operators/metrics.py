"""Exact evaluation metrics that never gather raw rows in one task.

Rows collapse to one line per distinct score first; running sums over those
lines come from range-partitioned slices, so continuous scores scale too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scalar import cases
from sitegauge.operators.ranking import running_totals, top_n

# Cut-offs of the ranked-list metrics and the calibration edges.
TOP_K = (50, 100, 200, 500)
CALIBRATION_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8)


def score_curve(df: DataFrame, score: str = "y_prob", label: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positives and negatives and the counts at or above them."""
    steps = df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    return running_totals(steps, by, [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def rank_metrics(df: DataFrame, score: str = "y_prob", label: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    """AUC (ties count half) and average precision per group, in one pass over the curve.

    With a single class AUC is 0.0; without positives average precision is 0.0.
    """
    curve = score_curve(df, score, label, by)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = curve.groupBy(*by).agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        # Negatives ranked above, or tied with, each positive.
        F.sum(pos * (fp - neg / 2.0)).alias("misordered"),
        F.sum(pos * tp / (tp + fp)).alias("precision_sum"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), 1.0 - F.col("misordered") / (F.col("p") * F.col("n"))).otherwise(0.0)
    return sums.select(*by, F.col("p").cast("bigint").alias("n_pos"), F.col("n").cast("bigint").alias("n_neg"),
                       auc.alias("auc_roc"),
                       F.when(F.col("p") > 0, F.col("precision_sum") / F.col("p")).otherwise(0.0).alias("average_precision"))


def accuracy(df: DataFrame, score: str = "y_prob", label: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    right = (F.col(score) >= 0.5).cast("int") == F.col(label).cast("int")
    return df.groupBy(*by).agg(F.avg(right.cast("double")).alias("accuracy"))


def at_k(df: DataFrame, key: str, ks: Sequence[int] = TOP_K, score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """(k, precision, recall) over the k best rows; a k above the row count gives no line."""
    best = top_n(df.select(key, score, F.col(label).cast("bigint").alias("_y")), [],
                 [F.col(score).desc(), key], max(ks), rank_name="_rank")
    lines = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = best.select("_rank", "_y", lines).filter(F.col("_rank") <= F.col("k")).groupBy("k").agg(
        F.sum("_y").alias("tp"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("k"))
    # A one-row table: the totals of the whole input.
    totals = df.agg(F.sum(F.col(label).cast("bigint")).alias("total"))
    joined = hits.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")
    return joined.select("k", (F.col("tp") / F.col("k")).alias("precision_at_k"),
                         F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0).alias("recall_at_k"))


def calibration(df: DataFrame, score: str = "y_prob", label: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction and outcome in five equal bins; an edge belongs to the lower bin."""
    p = F.col(score)
    bin_ = cases(*[(p <= e, F.lit(i)) for i, e in enumerate(CALIBRATION_EDGES)], otherwise=F.lit(len(CALIBRATION_EDGES)))
    return df.groupBy(*by, bin_.alias("bin")).agg(
        F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("actual"), F.count(F.lit(1)).alias("n"))


def regional_auc(df: DataFrame, group: str = "region", min_rows: int = 10, score: str = "y_prob",
                 label: str = "y_true") -> DataFrame:
    """AUC per region that has enough rows and both classes."""
    return rank_metrics(df, score, label, [group]).filter(
        (F.col("n_pos") + F.col("n_neg") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        group, (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc_roc")


# -- segmentation -----------------------------------------------------------

N_CLASSES = 11


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", n_classes: int = N_CLASSES) -> DataFrame:
    """Counts of every (label, pred) pair of the class grid, zeros included."""
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    spark: SparkSession = df.sparkSession
    grid = spark.range(n_classes * n_classes, numPartitions=1).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("label"), (F.col("id") % n_classes).cast("int").alias("pred"))
    return grid.join(counts, ["label", "pred"], "left").fillna(0, ["n"])


def class_metrics(cm: DataFrame) -> DataFrame:
    """IoU, precision, recall, F1 and support per class; a zero denominator gives NULL."""
    sides = cm.select("n", (F.col("label") == F.col("pred")).alias("hit"), F.explode(F.array(
        F.struct(F.col("label").alias("class_id"), F.lit("label").alias("side")),
        F.struct(F.col("pred").alias("class_id"), F.lit("pred").alias("side")))).alias("s"))
    of = lambda side: F.sum(F.when(F.col("s.side") == side, F.col("n")).otherwise(0))
    sums = sides.groupBy(F.col("s.class_id").alias("class_id")).agg(
        of("label").alias("support"), of("pred").alias("predicted"),
        F.sum(F.when(F.col("hit") & (F.col("s.side") == "label"), F.col("n")).otherwise(0)).alias("tp"))
    iou = F.try_divide(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))
    precision, recall = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    return sums.select("class_id", "support", "tp", iou.alias("iou"), precision.alias("precision"), recall.alias("recall"),
                       F.try_divide(2.0 * precision * recall, precision + recall).alias("f1"))


def mean_iou(per_class: DataFrame) -> DataFrame:
    """Mean IoU without background, overall accuracy and pixel count."""
    scored = (F.col("class_id") > 0) & (F.col("support") > 0)
    return per_class.agg(
        F.coalesce(F.avg(F.when(scored, F.col("iou"))), F.lit(0.0)).alias("mean_iou_no_bg"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("overall_accuracy"),
        F.sum("support").alias("total_pixels"))


def pair_pixels(pred: DataFrame, label: DataFrame, split: str | None = None) -> DataFrame:
    """Predictions and labels of the same window and pixel, optionally of one split."""
    side = label if split is None else label.filter(F.col("split") == split)
    return pred.select("window_id", "pixel", "pred").join(side.select("window_id", "pixel", "label"), ["window_id", "pixel"])


def long_report(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to (keys, metric, value)."""
    return df.unpivot([F.col(k) for k in keys], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


