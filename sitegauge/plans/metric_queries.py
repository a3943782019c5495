"""Evaluation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import metrics
from sitegauge.operators.reports import temporal_holdout
from sitegauge.plans.dataset_queries import _HOLD
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.registry import query


def _p(spark, d):
    return frame(spark, d, "predictions")


_CURVE = (", g AS (SELECT {by}y_prob, sum(y_true)::double AS pos, sum(1-y_true)::double AS neg FROM predictions GROUP BY {by}y_prob), "
          "c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM g WINDOW w AS ({part} ORDER BY y_prob DESC))")
_ALL = cte("predictions") + _CURVE.format(by="", part="")
_BY = cte("predictions") + _CURVE.format(by="region, ", part="PARTITION BY region")


@query("rank_for_auc", _ALL + " SELECT y_prob, tp::bigint AS tp, fp::bigint AS fp FROM c")
def rank_for_auc(spark, d):
    return metrics.score_curve(_p(spark, d)).select("y_prob", "tp", "fp")


@query("cumulative_pr", _ALL + " SELECT y_prob, round(tp/(tp+fp), 9) AS \"precision\", round(tp/p, 9) AS recall FROM c")
def cumulative_pr(spark, d):
    curve = metrics.score_curve(_p(spark, d))
    total = curve.agg(F.max("tp").alias("p")).withColumn("_one", F.lit(1))   # one row
    both = curve.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return both.select("y_prob", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("tp") / F.col("p"), 9).alias("recall"))


@query("auc_roc", _ALL + " SELECT round(sum(neg*(tp-pos/2.0::double))/(max(p)*max(n)), 9) AS auc_roc, max(p)::bigint AS n_pos, max(n)::bigint AS n_neg FROM c")
def auc_roc(spark, d):
    return metrics.rank_metrics(_p(spark, d)).select(F.round("auc_roc", 9).alias("auc_roc"), "n_pos", "n_neg")


@query("average_precision", _ALL + " SELECT round(sum(pos/p*tp/(tp+fp)), 9) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.rank_metrics(_p(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("accuracy_at_half", cte("predictions") + " SELECT round(avg(CASE WHEN (y_prob>=0.5::double)=(y_true=1) THEN 1.0::double ELSE 0 END), 9) AS accuracy FROM predictions")
def accuracy_at_half(spark, d):
    return metrics.accuracy(_p(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


@query("precision_recall_at_k", cte("predictions") + ", r AS (SELECT *, row_number() OVER (ORDER BY y_prob DESC, row_id) AS rn FROM predictions), k AS (SELECT unnest([50,100,200,500]) AS k) "
       "SELECT k, round(sum(y_true)/k, 9) AS precision_at_k, round(sum(y_true)/(SELECT sum(y_true) FROM predictions), 9) AS recall_at_k FROM k JOIN r ON rn<=k GROUP BY k HAVING count(*)=k")
def precision_recall_at_k(spark, d):
    out = metrics.at_k(_p(spark, d), "row_id")
    return out.select("k", F.round("precision_at_k", 9).alias("precision_at_k"), F.round("recall_at_k", 9).alias("recall_at_k"))


@query("calibration_bins", cte("predictions") + " SELECT cast(CASE WHEN y_prob<=0.2::double THEN 0 WHEN y_prob<=0.4::double THEN 1 WHEN y_prob<=0.6000000000000001::double THEN 2 WHEN y_prob<=0.8::double THEN 3 ELSE 4 END AS int) AS bin, round(avg(y_prob), 9) AS predicted, round(avg(y_true), 9) AS actual, count(*) AS n FROM predictions GROUP BY 1")
def calibration_bins(spark, d):
    out = metrics.calibration(_p(spark, d))
    return out.select("bin", F.round("predicted", 9).alias("predicted"), F.round("actual", 9).alias("actual"), "n")


@query("regional_auc", _BY + " SELECT region, (max(p)+max(n))::bigint AS n, round(sum(neg*(tp-pos/2.0::double))/(max(p)*max(n)), 9) AS auc_roc FROM c GROUP BY region HAVING max(p)+max(n)>=10 AND max(p)>0 AND max(n)>0")
def regional_auc(spark, d):
    return metrics.regional_auc(_p(spark, d)).withColumn("auc_roc", F.round("auc_roc", 9))


@query("metrics_report", _ALL + ", m AS (SELECT round(sum(neg*(tp-pos/2.0::double))/(max(p)*max(n)), 9) AS auc_roc, round(sum(pos/p*tp/(tp+fp)), 9) AS average_precision FROM c) SELECT 'all' AS config, 'auc_roc' AS metric, auc_roc AS value FROM m UNION ALL SELECT 'all', 'average_precision', average_precision FROM m")
def metrics_report(spark, d):
    wide = metrics.rank_metrics(_p(spark, d)).select(F.lit("all").alias("config"), F.round("auc_roc", 9).alias("auc_roc"), F.round("average_precision", 9).alias("average_precision"))
    return metrics.long_report(wide, ["config"], ["auc_roc", "average_precision"])


_CM = cte("class_pixels") + ", cm AS (SELECT a.label, b.pred, count(x.label) AS n FROM (SELECT unnest(range(11))::int AS label) a CROSS JOIN (SELECT unnest(range(11))::int AS pred) b LEFT JOIN class_pixels x ON x.label=a.label AND x.pred=b.pred GROUP BY 1,2)"
_PC = (_CM + ", pc AS (SELECT class_id, sum(n) FILTER (WHERE label=class_id) AS support, sum(n) FILTER (WHERE pred=class_id) AS predicted, sum(n) FILTER (WHERE label=class_id AND pred=class_id) AS tp FROM cm, (SELECT unnest(range(11))::int AS class_id) GROUP BY 1), "
       "m AS (SELECT class_id, support, tp, tp/nullif(support+predicted-tp, 0) AS iou, tp/nullif(predicted, 0) AS pr, tp/nullif(support, 0) AS rc FROM pc)")


@query("confusion_matrix", _CM + " SELECT label, pred, n FROM cm")
def confusion_matrix(spark, d):
    return metrics.confusion(frame(spark, d, "class_pixels"))


@query("class_metrics", _PC + " SELECT class_id, support::bigint AS support, round(iou, 9) AS iou, round(pr, 9) AS \"precision\", round(rc, 9) AS recall, round(2*pr*rc/nullif(pr+rc, 0), 9) AS f1 FROM m")
def class_metrics(spark, d):
    out = metrics.class_metrics(metrics.confusion(frame(spark, d, "class_pixels")))
    return out.select("class_id", "support", *[F.round(c, 9).alias(c) for c in ("iou", "precision", "recall", "f1")])


@query("mean_iou", _PC + " SELECT round(avg(iou) FILTER (WHERE class_id>0 AND support>0), 9) AS mean_iou_no_bg, round(sum(tp)/sum(support), 9) AS overall_accuracy, sum(support)::bigint AS total_pixels FROM m")
def mean_iou(spark, d):
    out = metrics.mean_iou(metrics.class_metrics(metrics.confusion(frame(spark, d, "class_pixels"))))
    return out.select(F.round("mean_iou_no_bg", 9).alias("mean_iou_no_bg"), F.round("overall_accuracy", 9).alias("overall_accuracy"), "total_pixels")


@query("pred_label_pairing", cte("pred_pixels", "label_pixels") + " SELECT p.window_id, p.pred, l.label, count(*) AS n FROM pred_pixels p JOIN label_pixels l USING (window_id, pixel) WHERE l.split='val' GROUP BY 1,2,3")
def pred_label_pairing(spark, d):
    pairs = metrics.pair_pixels(frame(spark, d, "pred_pixels"), frame(spark, d, "label_pixels"), "val")
    return pairs.groupBy("window_id", "pred", "label").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_distance_auc", _HOLD + ", pr AS (SELECT -round(km, 6) AS y_prob, CASE WHEN te.loc_id%8=3 THEN 1 ELSE 0 END AS y_true FROM te JOIN nr ON nr.lat=te.lat AND nr.lon=te.lon), "
       "g AS (SELECT y_prob, sum(y_true)::double AS pos, sum(1-y_true)::double AS neg FROM pr GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY y_prob DESC) AS tp FROM g) "
       "SELECT round(sum(neg*(tp-pos/2.0::double))/(sum(pos)*sum(neg)), 9) AS auc_roc, count(*) AS n_scores FROM c")
def temporal_distance_auc(spark, d):
    """The distance-only baseline of the temporal hold-out: nearer to an early site means more likely."""
    late = temporal_holdout(frame(spark, d, "locations"), "loc_id")
    rows = late.select((-F.round("train_km", 6)).alias("y_prob"), (F.col("loc_id") % 8 == 3).cast("int").alias("y_true"))
    scores = rows.select("y_prob").distinct().agg(F.count(F.lit(1)).alias("n_scores")).withColumn("_one", F.lit(1))
    return metrics.rank_metrics(rows).withColumn("_one", F.lit(1)).join(F.broadcast(scores), "_one").select(
        F.round("auc_roc", 9).alias("auc_roc"), "n_scores")
