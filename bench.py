"""Time the headline queries and print one JSON line.

Every query runs twice and the second run counts, so code generation and file
listing are warm. The result is consumed by the no-op sink: all rows and columns
are computed, none travels to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitegauge.plans.registry import load_all  # noqa: E402
from sitegauge.session import local_session  # noqa: E402

HEADLINE = (
    "score_sites", "factor_matrix", "score_all_types", "combined_score", "compare_scenarios", "assess_climate_risk",
    "parse_eia_generators", "parse_overpass_points", "osm_ways_to_polygons", "merge_pipeline_report", "dedup_grid",
    "nearest_within_deg", "nearest_feature_distance", "radius_count", "idw_interpolate", "point_in_polygon",
    "bbox_overlap_join", "reverse_geocode", "scene_catalog_search", "sample_positives_v1", "negatives_v2", "build_dataset",
    "stratified_split", "data_quality", "summary_counts", "assemble_measurements", "auc_roc", "precision_recall_at_k",
    "calibration_bins", "class_metrics", "scanline_fill", "label_source_stats", "embedding_quality", "stream_trailing_means",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
