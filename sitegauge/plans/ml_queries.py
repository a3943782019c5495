"""Model queries, on whole tables and with the published model sizes.

A fit cannot be written in SQL. The queries return what can: which rows train and test, labels and predictions that
belong together, and facts that a correct fit has to fulfil. Metrics as such come from the operators.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from sitegauge.functions.scalar import ENERGY_TYPES
from sitegauge.operators import ml, reports
from sitegauge.operators.dataset import stratified_split
from sitegauge.operators.features import external_features, geo_features
from sitegauge.plans.dataset_queries import u_sql
from sitegauge.plans.fixtures import cte, frame
from sitegauge.plans.registry import query

MODELS = ml.Settings()


def _rows(spark, d):
    """Embedded locations with their vectors as ``features``."""
    both = frame(spark, d, "embedded").join(frame(spark, d, "vectors"), "vec_id")
    return ml.as_vector(both, "embedding").select("vec_id", "lat", "lon", "energy_type", "country_code", "label", "features")


@query("standard_scale", cte("vectors") + ", x AS (SELECT unnest(embedding)::double AS v, generate_subscripts(embedding, 1)-1 AS dim FROM vectors) SELECT dim::int AS dim, round(avg(v), 6)+0 AS mean, round(stddev_pop(v), 6) AS sd FROM x GROUP BY 1")
def standard_scale(spark, d):
    out = ml.scale_statistics(frame(spark, d, "vectors"), "embedding")
    return out.select("dim", (F.round("mean", 6) + 0.0).alias("mean"), F.round("sd", 6).alias("sd"))


@query("scaled_vectors", cte("vectors") + ", x AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1)-1 AS dim FROM vectors), s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY 1) "
       "SELECT vec_id, round(sum((v-m)/sd*(dim+1)), 5)+0 AS weighted FROM x JOIN s USING (dim) GROUP BY 1")
def scaled_vectors(spark, d):
    """z-scores of every vector, summed with the position as weight."""
    scaled = ml.standard_scale(ml.as_vector(frame(spark, d, "vectors"), "embedding"))[0]
    z = scaled.select("vec_id", F.posexplode(vector_to_array("features")).alias("dim", "z"))
    return z.groupBy("vec_id").agg((F.round(F.sum(F.col("z") * (F.col("dim") + 1)), 5) + 0.0).alias("weighted"))


def _split_sql(source: str = "embedded", by: str = "label") -> str:
    """CTE ``split``: the stratified test fifth."""
    return (f", r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {u_sql('vec_id')}, vec_id) AS place, count(*) OVER (PARTITION BY {by}) AS n FROM {source}), "
            "split AS (SELECT *, place<=round_even(n*0.2::double, 0) AS is_test FROM r)")


_SIZES = ("count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test AND label=1) AS n_pos, "
          "count(*) FILTER (WHERE is_test AND label=0) AS n_neg")
_KINDS = ("logistic", "gbt", "mlp")


def _trained(kind: str):
    def run(spark, d):
        out = ml.train_and_report(_rows(spark, d), "vec_id", kind, MODELS)
        return out.select(F.lit(kind).alias("model"), "n_train", "n_pos", "n_neg", "beats_constant")
    return run


for _name, _kind in (("train_logistic", "logistic"), ("train_gbt", "gbt"), ("train_mlp", "mlp")):
    query(_name, cte("embedded") + _split_sql() + f" SELECT '{_kind}' AS model, {_SIZES}, true AS beats_constant FROM split")(_trained(_kind))


@query("predict_table", cte("embedded") + _split_sql() + " SELECT vec_id, lat, lon, energy_type, label AS y_true, true AS consistent FROM split WHERE is_test")
def predict_table(spark, d):
    """Test rows with their label; ``consistent`` tells that the class follows from a probability inside (0, 1)."""
    out = ml.train_and_score(_rows(spark, d), "vec_id", "logistic", ["lat", "lon", "energy_type"], MODELS)
    fine = (F.col("y_prob") > 0) & (F.col("y_prob") < 1) & (F.col("y_pred") == (F.col("y_prob") >= 0.5).cast("int"))
    return out.select("vec_id", "lat", "lon", "energy_type", "y_true", fine.alias("consistent"))


@query("topk_importance", "SELECT unnest(range(1, 21))::int AS place, true AS known, true AS in_order, true AS useful")
def topk_importance(spark, d):
    """The 20 most important dimensions: places, known names, falling importance within a total of 1, and above that of a mean dimension at first."""
    rows = _rows(spark, d)
    model = ml.fit(rows, "gbt", MODELS)
    names = [f"emb_{i}" for i in range(model.numFeatures)]
    top = ml.feature_importance(model, names, rows).collect()   # 20 rows
    facts = [(i + 1, r["feature"] in names, 0 <= r["importance"] <= 1 and (i == 0 or r["importance"] <= top[i - 1]["importance"]),
              r["importance"] > 0 and (i > 0 or r["importance"] > 1 / len(names)))
             for i, r in enumerate(top)]
    return spark.createDataFrame(facts, "place int, known boolean, in_order boolean, useful boolean")


_SETS = ("embeddings", "external", "both")


def _ablation(spark, d):
    names = ["abs_lat", "cos_lat", "lon_norm", "lat_sq", "sin_lon", "cos_lon", "belt_distance", "high_lat"]
    rows = _rows(spark, d)
    wide = rows.select("vec_id", "label", F.col("features").alias("emb"), *external_features(F.col("lat"), F.col("lon")))
    return ml.ablation(wide, "vec_id", {"embeddings": ["emb"], "external": names, "both": ["emb", *names]}, _KINDS, MODELS)


@query("ablation", cte("embedded") + _split_sql() + f", m AS (SELECT {_SIZES}, true AS beats_constant FROM split) SELECT f.features, k.model, m.* FROM m, "
       f"(SELECT unnest({list(_SETS)}) AS features) f, (SELECT unnest({list(_KINDS)}) AS model) k")
def ablation(spark, d):
    return _ablation(spark, d).select("features", "model", "n_train", "n_pos", "n_neg", "beats_constant")


@query("ablation_deltas", f"SELECT model, over, true AS consistent FROM (SELECT unnest({list(_KINDS)}) AS model), (SELECT unnest({list(_SETS[:2])}) AS over)")
def ablation_deltas(spark, d):
    """Every model and single set; the gain added to the single set's metric gives that of both."""
    found = spark.createDataFrame(_ablation(spark, d).collect())   # nine rows
    auc = {(r["model"], r["features"]): r["auc_roc"] for r in found.collect()}
    facts = [(r["model"], r["over"], abs(auc[r["model"], r["over"]] + r["auc_delta"] - auc[r["model"], "both"]) < 1e-12)
             for r in ml.ablation_deltas(found).collect()]
    return spark.createDataFrame(facts, "model string, over string, consistent boolean")


def _folds_sql(source: str) -> str:
    return (f", f AS (SELECT label, cast(ntile(5) OVER (PARTITION BY label ORDER BY {u_sql('vec_id')}, vec_id)-1 AS int) AS fold FROM {source}), "
            "g AS (SELECT fold, count(*) FILTER (WHERE label=1) AS n_pos, count(*) FILTER (WHERE label=0) AS n_neg FROM f GROUP BY 1)")


def _fold_facts(folds):
    return folds.select("fold", "n_pos", "n_neg", F.col("auc_roc").between(0.0, 1.0).alias("auc_valid"), "n_train", "beats_constant")


_FOLD_FACTS = "g.*, true AS auc_valid, sum(n_pos+n_neg) OVER ()::bigint-n_pos-n_neg AS n_train, true AS beats_constant"


@query("cross_validate", cte("embedded") + _split_sql() + ", seen AS (SELECT label, vec_id FROM split WHERE NOT is_test)" + _folds_sql("seen") + f" SELECT {_FOLD_FACTS} FROM g")
def cross_validate(spark, d):
    """Folds of the training part only; the test fifth stays out."""
    train = stratified_split(_rows(spark, d), "label", "vec_id").filter("NOT is_test")
    return _fold_facts(ml.cross_validate(train, "vec_id", "gbt", 5, MODELS))


@query("t1_vs_tmulti", cte("embedded") + ", s AS (SELECT * FROM embedded WHERE vec_id%4=0)" + _folds_sql("s") + f", h AS (SELECT {_FOLD_FACTS} FROM g) SELECT v.variant, h.* FROM h, (SELECT unnest(['single', 'multi']) AS variant) v")
def t1_vs_tmulti(spark, d):
    """Four consecutive vectors stand for the four seasons of a site: the first alone against their mean."""
    rows = _rows(spark, d)
    site = (F.col("vec_id") - F.col("vec_id") % 4).alias("vec_id")
    first = rows.filter(F.col("vec_id") % 4 == 0).select("vec_id", "label", "features")
    mean = rows.groupBy(site).agg(Summarizer.mean(F.col("features")).alias("features"))
    out = None
    for name, variant in (("single", first), ("multi", first.drop("features").join(mean, "vec_id"))):
        weighted = ml.balanced_weights(variant)
        folds = ml.cross_validate(weighted, "vec_id", "logistic", ml.usable_folds(weighted, 5), MODELS, weight="weight", scale=True)
        line = _fold_facts(folds).withColumn("variant", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


@query("geo_baseline", cte("embedded") + ", big AS (SELECT * FROM embedded WHERE energy_type IN (SELECT energy_type FROM embedded GROUP BY 1 HAVING count(*)>=100))"
       + _split_sql("big", "energy_type, label") + " SELECT energy_type, count(*) FILTER (WHERE is_test AND label=1) AS n_pos, count(*) FILTER (WHERE is_test AND label=0) AS n_neg, true AS auc_valid, true AS at_optimum FROM split GROUP BY 1")
def geo_baseline(spark, d):
    out = ml.per_type_baseline(_rows(spark, d), "vec_id", ENERGY_TYPES, geo_features, MODELS)
    return out.select("energy_type", "n_pos", "n_neg", F.col("auc_roc").between(0.0, 1.0).alias("auc_valid"), (F.col("slope") < 1e-5).alias("at_optimum"))


@query("spatial_cv", cte("embedded") + ", g AS (SELECT country_code, count(*) FILTER (WHERE label=1) AS n_pos, count(*) FILTER (WHERE label=0) AS n_neg FROM embedded GROUP BY 1) SELECT *, true AS auc_valid, true AS at_optimum FROM g WHERE n_pos>=5 AND n_neg>=5")
def spatial_cv(spark, d):
    rows = _rows(spark, d)
    # One model per country, all in one fit.
    countries = sorted(r[0] for r in reports.eligible_groups(rows, "country_code").select("country_code").collect())
    out = ml.leave_one_out(rows, "country_code", countries, "vec_id", settings=MODELS)
    return out.select("country_code", "n_pos", "n_neg", F.col("auc_roc").between(0.0, 1.0).alias("auc_valid"), (F.col("slope") < 1e-5).alias("at_optimum"))


@query("temporal_cv", cte("embedded") + ", y AS (SELECT label, vec_id%10+2014>=2020 AS is_test FROM embedded) " + f"SELECT {_SIZES}, true AS beats_constant FROM y")
def temporal_cv(spark, d):
    """Train on early rows, test on late ones; the year follows from the key."""
    rows = _rows(spark, d).withColumn("year", (F.col("vec_id") % 10 + 2014).cast("int"))
    train, test = ml.standard_scale(rows.filter(F.col("year") < 2020), rows.filter(F.col("year") >= 2020))
    return ml.report(ml.fit(train, "logistic", MODELS), train, test).select("n_train", "n_pos", "n_neg", "beats_constant")


@query("label_shuffle_test", cte("embedded") + f", a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embedded), b AS (SELECT label, row_number() OVER (ORDER BY {u_sql('vec_id', 'shuffle')}, vec_id) AS k FROM embedded), "
       "m AS (SELECT vec_id, label FROM a JOIN b USING (k))" + _split_sql("m") + " SELECT vec_id, label AS y_true FROM split WHERE is_test")
def label_shuffle_test(spark, d):
    """Test rows under permuted labels, as the model scored them."""
    shuffled = ml.shuffle_labels(_rows(spark, d), "vec_id")
    return ml.train_and_score(shuffled, "vec_id", "logistic", settings=MODELS).filter(F.col("y_prob").between(0.0, 1.0)).select("vec_id", "y_true")


@query("learning_curve", cte("embedded") + _split_sql() + f", c AS (SELECT s.share, split.* FROM split, (SELECT unnest([0.1::double, 0.25::double, 0.5::double, 0.75::double, 1.0::double]) AS share) s WHERE is_test OR {u_sql('vec_id', 'curve')}/4294967296.0::double<s.share) "
       f"SELECT share, {_SIZES}, true AS beats_constant FROM c GROUP BY 1")
def learning_curve(spark, d):
    return ml.learning_curve(_rows(spark, d), "vec_id", settings=MODELS).select("share", "n_train", "n_pos", "n_neg", "beats_constant")


@query("pca_variance", "SELECT unnest(range(1, 51))::int AS component, true AS in_order, true AS sums_up, true AS covers")
def pca_variance(spark, d):
    """Shares of variance fall, their running total is right, stays within 1 and covers at least what as many single dimensions do."""
    rows = _rows(spark, d)
    found = ml.pca_variance(rows, 50).orderBy("component").collect()   # 50 rows
    single = sorted((r["sd"] ** 2 for r in ml.scale_statistics(rows.withColumn("x", vector_to_array("features")), "x").collect()), reverse=True)
    total, least, facts = 0.0, 0.0, []
    for i, r in enumerate(found):
        total += r["variance"]
        least += single[i] / sum(single)
        facts.append((r["component"], i == 0 or r["variance"] <= found[i - 1]["variance"], abs(total - r["cumulative"]) < 1e-9 and total < 1 + 1e-9,
                      total > least - 1e-9))
    return spark.createDataFrame(facts, "component int, in_order boolean, sums_up boolean, covers boolean")
