"""Plan checks: no cross products, no Python rows, pruned scans."""

import pytest

from sitegauge.plans.registry import load_all


def _plan(spark, sf_dir, name):
    df = load_all()[name].run(spark, sf_dir)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", [
    "score_sites", "score_all_types", "combined_score", "compare_scenarios", "nearest_within_deg", "nearest_feature_distance",
    "radius_count", "idw_interpolate", "point_in_polygon", "bbox_overlap_join", "exclude_near_cells_3x3", "dedup_grid",
    "sample_positives_v2", "stratified_split", "auc_roc", "scanline_fill", "scene_catalog_search"])
def test_no_cross_product_or_python(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["score_sites", "factor_matrix", "score_all_types", "compare_scenarios", "assess_climate_risk"])
def test_projections_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in _plan(spark, sf_dir, name)


def test_scan_reads_only_what_is_used(spark, sf_dir):
    plan = _plan(spark, sf_dir, "calibration_bins")
    schema = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schema and "l_extendedprice" not in schema[0] and "l_shipdate" not in schema[0]


def test_model_queries_have_the_published_sizes():
    from sitegauge.operators import ml
    from sitegauge.plans import ml_queries
    assert ml_queries.MODELS == ml.Settings() and ml_queries.MODELS.trees == 300
