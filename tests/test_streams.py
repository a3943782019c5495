"""Streams against batch results."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitegauge.session import scratch_path
from sitegauge.streaming import jobs


def test_trailing_means_equal_batch(spark):
    """Several files, NULL and negative values, a site without valid readings; windows that the watermark has closed."""
    start = datetime(2024, 1, 1)
    rows = [(k % 3, start + timedelta(hours=7 * k), None if k % 7 == 0 else -1.0 if k % 11 == 0 or k % 3 == 2 else float(k)) for k in range(60)]
    folder = scratch_path(spark, "readings")
    schema = "site_id long, ts timestamp, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20:part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(folder)
    out = scratch_path(spark, "means")
    means = jobs.trailing_means(jobs.landing_stream(spark, folder, schema, files_per_trigger=1), length="5 days", lateness="2 days")
    jobs.catch_up(means, out, scratch_path(spark, "state"))
    got = {(r["site_id"], r["window_start"]): (r["mean_value"], r["n"]) for r in spark.read.schema(means.schema).parquet(out).collect()}
    last = max(t for _, t, _ in rows) - timedelta(days=2)
    want = {}
    for site in range(3):
        for day in range(-5, 30):
            a, b = start + timedelta(days=day), start + timedelta(days=day + 5)
            inside = [v for s, t, v in rows if s == site and a <= t < b]
            valid = [v for v in inside if v is not None and v >= 0]
            if inside and b <= last:
                want[site, a] = (sum(valid) / len(valid) if valid else None, len(inside))
    assert got.keys() == want.keys() and len(want) > 3
    assert all(got[k][1] == n and got[k][0] == pytest.approx(m) for k, (m, n) in want.items())


def test_failed_batches_leave_each_row_once(spark):
    folder, done, failed, state = (scratch_path(spark, n) for n in ("in", "done", "failed", "split"))
    schema = "id long, value double"
    for part in range(3):
        spark.createDataFrame([(10 * part + i, None if i == 0 else float(i - 2)) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.landing_stream(spark, folder, schema, files_per_trigger=1)
    # A first start breaks in its second batch, after the processed rows are written and before the failed ones are.
    broken = F.when(F.col("id") >= 10, F.raise_error(F.lit("no room"))).otherwise(F.lit("bad"))
    with pytest.raises(Exception):
        jobs.split_batches(stream, F.col("value") >= 0, done, failed, state, broken)
    jobs.split_batches(stream, F.col("value") >= 0, done, failed, state, F.lit("bad"))
    ok = [r["id"] for r in spark.read.option("recursiveFileLookup", True).schema(schema).parquet(done).collect()]
    bad = [r["id"] for r in spark.read.option("recursiveFileLookup", True).schema(schema).parquet(failed).collect()]
    assert sorted(ok) == [10 * p + i for p in range(3) for i in (2, 3, 4)] and sorted(bad) == [10 * p + i for p in range(3) for i in (0, 1)]


def test_means_of_days_equal_the_windows_of_the_stream(spark):
    """Gaps, a site without valid readings, several files; and no window is made that the watermark leaves open."""
    start = datetime(2024, 1, 1)
    rows = [(k % 3, start + timedelta(hours=7 * k + (200 if k > 40 else 0)), None if k % 7 == 0 else -1.0 if k % 3 == 2 else float(k)) for k in range(60)]
    folder = scratch_path(spark, "readings")
    schema = "site_id long, ts timestamp, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20:part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.landing_stream(spark, folder, schema, files_per_trigger=1)
    out, days_out = scratch_path(spark, "means"), scratch_path(spark, "days")
    means, days = jobs.trailing_means(stream, length="6 days"), jobs.daily_sums(stream)
    jobs.catch_up(means, out, scratch_path(spark, "state"))
    closed = jobs.watermark_of(jobs.catch_up(days, days_out, scratch_path(spark, "state")))
    got = jobs.means_of_days(spark.read.schema(days.schema).parquet(days_out), closed, 6)
    want = [tuple(r) for r in spark.read.schema(means.schema).parquet(out).orderBy("site_id", "window_start").collect()]
    assert [tuple(r) for r in got.orderBy("site_id", "window_start").collect()] == want and len(want) > 30
    assert jobs.means_of_days(spark.read.schema(days.schema).parquet(days_out), None, 6).count() == 0
