"""Streaming queries: each one catches up on a folder and is checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators.scoring import Scorecard
from sitegauge.plans.fixtures import TABLES, base, cte, frame
from sitegauge.plans.registry import query
from sitegauge.plans.scoring_queries import FACTORS_CTE, overall_sql
from sitegauge.session import scratch_path
from sitegauge.streaming import jobs


def _stream(spark, d, table):
    """One given table as a file stream: the folder with a name filter."""
    return jobs.landing_stream(spark, d, base(spark, d, table).schema, glob=f"{table}.parquet")


def _run(spark, df, name):
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    jobs.catch_up(df, out, state)
    return spark.read.schema(df.schema).parquet(out)


@query("stream_score", FACTORS_CTE + f" SELECT site_id, round({overall_sql('solar')}, 9) AS overall_score FROM factors")
def stream_score(spark, d):
    sites = spark.sql(TABLES["sites"], customer=_stream(spark, d, "customer"))
    scored = jobs.score_stream(sites, Scorecard.of("solar")).select("site_id", F.round("overall_score", 9).alias("overall_score"))
    return _run(spark, scored, "scores")


def _windows_sql(days: int) -> str:
    return (cte("readings") + f", w AS (SELECT site_id, unnest(generate_series(date_trunc('day', ts)-INTERVAL {days - 1} DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS window_start, discharge FROM readings), "
            f"g AS (SELECT site_id, window_start, window_start+INTERVAL {days} DAY AS window_end, avg(CASE WHEN discharge>=0 THEN discharge END) AS m, count(*) AS n FROM w GROUP BY 1,2) "
            "SELECT site_id, strftime(window_start, '%Y-%m-%d') AS window_start, round(m, 9) AS mean_value, n FROM g WHERE window_end<=(SELECT max(ts)-INTERVAL 1 DAY FROM readings)")


def _readings(spark, d):
    readings = spark.sql(TABLES["readings"], events=_stream(spark, d, "events"))
    return readings.select("site_id", F.col("ts").cast("timestamp").alias("ts"), F.col("discharge").alias("value"))


def _reported(means):
    return means.select("site_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.round("mean_value", 9).alias("mean_value"), "n")


@query("stream_trailing_means", _windows_sql(10))
def stream_trailing_means(spark, d):
    """Windows closed by the watermark, in append mode."""
    return _reported(_run(spark, jobs.trailing_means(_readings(spark, d), length="10 days"), "means"))


@query("stream_trailing_year", _windows_sql(365))
def stream_trailing_year(spark, d):
    """The same over a year, as the measurements take it: the stream writes the sums of closed days, and the windows are ranges of them."""
    days, out, state = jobs.daily_sums(_readings(spark, d)), scratch_path(spark, "days"), scratch_path(spark, "days-state")
    done = jobs.catch_up(days, out, state)
    return _reported(jobs.means_of_days(spark.read.schema(days.schema).parquet(out), jobs.watermark_of(done), 365))


@query("stream_failed_rows", cte("readings") + " SELECT event_id, coalesce(discharge>=0, false) AS processed, CASE WHEN discharge>=0 THEN NULL WHEN discharge<0 THEN 'negative' ELSE 'missing' END AS reason FROM readings")
def stream_failed_rows(spark, d):
    """Readings in two places, told apart batch by batch; the start after a failure repeats a batch without repeating rows."""
    folder, done, failed, state, other = (scratch_path(spark, n) for n in ("arriving", "processed", "failed", "split-state", "split-state"))
    readings = frame(spark, d, "readings").select("event_id", "discharge")
    for remainder in (0, 1):
        readings.filter(F.col("event_id") % 2 == remainder).coalesce(1).write.mode("append").parquet(folder)
    v = F.col("discharge")
    for checkpoint in (state, other):   # another checkpoint has no memory of the batches: all are written again, in place
        stream = jobs.landing_stream(spark, folder, readings.schema, files_per_trigger=1)
        jobs.split_batches(stream, v >= 0, done, failed, checkpoint, F.when(v < 0, "negative").otherwise("missing"))
    ok = spark.read.schema(readings.schema).option("recursiveFileLookup", True).parquet(done)
    bad = spark.read.schema(readings.schema.add("reason", "string")).option("recursiveFileLookup", True).parquet(failed)
    return ok.select("event_id", F.lit(True).alias("processed"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", F.lit(False).alias("processed"), "reason"))


@query("stream_ingest_dedup", cte("readings") + " SELECT DISTINCT site_id, event_type FROM readings")
def stream_ingest_dedup(spark, d):
    """The first arrival per (site, kind): the span of the data fits inside the lateness."""
    readings = spark.sql(TABLES["readings"], events=_stream(spark, d, "events"))
    rows = readings.select("site_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = _run(spark, jobs.ingest_dedup(rows, ["site_id", "event_type"], "60 days"), "dedup")
    return out.select("site_id", "event_type")


@query("stream_resume", cte("readings") + " SELECT event_id, CASE WHEN event_id%2=0 THEN 'even' ELSE 'odd' END AS arrival FROM readings")
def stream_resume(spark, d):
    """Two starts on one checkpoint: the second start reads only the files that arrived in between."""
    folder, out, state = (scratch_path(spark, n) for n in ("arrivals", "resumed", "resumed-state"))
    readings = frame(spark, d, "readings")
    for remainder, name in ((0, "even"), (1, "odd")):
        readings.filter(F.col("event_id") % 2 == remainder).select("event_id", F.lit(name).alias("arrival")).write.mode("append").parquet(folder)
        jobs.catch_up(jobs.landing_stream(spark, folder, "event_id bigint, arrival string"), out, state)
    return spark.read.schema("event_id bigint, arrival string").parquet(out)
