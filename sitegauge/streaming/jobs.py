"""Structured Streaming jobs: the batch transforms on unbounded input.

All jobs read files from a landing folder and stop when they have caught up
(``availableNow``); the checkpoint remembers what was processed, so the next
start resumes where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitegauge.operators.scoring import Scorecard, score_sites


DAY_SECONDS = 86_400


def landing_stream(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet",
                   glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over a landing folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def catch_up(df: DataFrame, out: str, checkpoint: str, mode: str = "append",
             partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Process everything available into Parquet and stop. Exactly once per input file."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def catch_up_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                     mode: str = "update") -> StreamingQuery:
    """The same for sinks that need a function per batch. ``handle`` must be idempotent per batch id."""
    query = df.writeStream.foreachBatch(handle).outputMode(mode).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def score_stream(sites: DataFrame, card: Scorecard) -> DataFrame:
    """Suitability on a stream: stateless, the batch projection unchanged."""
    return score_sites(sites, card)


def daily_sums(readings: DataFrame, site: str = "site_id", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Readings summed once for each site and ``slide``, in state that the watermark closes; later rows than ``lateness`` are dropped."""
    v = F.col("value")
    return (
        readings.withWatermark("ts", lateness)
        .groupBy(site, F.window("ts", slide).alias("day"))
        .agg(F.sum(F.when(v >= 0, v)).alias("total"), F.count_if(v >= 0).alias("valid"), F.count(F.lit(1)).alias("rows")))


def trailing_means(readings: DataFrame, site: str = "site_id", length: str = "365 days", slide: str = "1 day",
                   lateness: str = "1 day") -> DataFrame:
    """Mean of valid readings per site in sliding windows; later rows than ``lateness`` are dropped.

    Only the sums of ``daily_sums`` are copied into the windows they belong to, so state and work follow sites and days, whatever the number
    of readings. ``length`` must be a multiple of ``slide``. State holds every window a day may lie in; for long windows write the daily sums and
    read them with ``means_of_days``. ``n`` counts all readings, ``mean_value`` is that of the valid ones (NULL if there are none).
    """
    return (
        daily_sums(readings, site, slide, lateness).withColumn("at", F.window_time("day"))
        .groupBy(site, F.window("at", length, slide).alias("w"))
        .agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"), F.sum("rows").alias("n"))
        .select(site, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                F.try_divide("total", "valid").alias("mean_value"), "n"))


def watermark_of(query: StreamingQuery) -> datetime | None:
    """Event time up to which a stopped query has closed its state (UTC); None if it never saw any."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    return max((datetime.fromisoformat(m) for m in marks), default=None)


def means_of_days(days: DataFrame, closed: datetime | None, length: int, site: str = "site_id") -> DataFrame:
    """The rows of ``trailing_means`` for windows of ``length`` days that end by ``closed``, from the written ``daily_sums``.

    A site's windows are those that end from its first day on; each is the range of the days before its end, so work follows the
    days and the rows returned, and windows that are still open are never made.
    """
    number = F.floor(F.unix_seconds("day.end") / DAY_SECONDS)
    last = F.lit(int(closed.timestamp()) // DAY_SECONDS if closed else None).cast("bigint")
    sums = days.select(site, number.alias("end"), "total", "valid", "rows")
    latest = F.when(last.isNotNull(), F.least(F.max("end") + (length - 1), last))
    every = sums.groupBy(site).agg(F.min("end").alias("lo"), latest.alias("hi")).filter("lo <= hi").select(site, F.explode(F.sequence("lo", "hi")).alias("end"))
    ends = every.select(site, "end", F.lit(None).cast("double").alias("total"), F.lit(0).cast("bigint").alias("valid"), F.lit(0).cast("bigint").alias("rows"),
                        F.lit(True).alias("asked"))
    before = Window.partitionBy(site).orderBy("end").rangeBetween(1 - length, Window.currentRow)
    summed = sums.withColumn("asked", F.lit(False)).unionByName(ends).select(
        site, "end", "asked", F.sum("total").over(before).alias("total"), F.sum("valid").over(before).alias("valid"), F.sum("rows").over(before).alias("n"))
    midnight = lambda day: F.timestamp_seconds(day * DAY_SECONDS)
    return summed.filter("asked AND n > 0").select(
        site, midnight(F.col("end") - length).alias("window_start"), midnight(F.col("end")).alias("window_end"), F.try_divide("total", "valid").alias("mean_value"), "n")


def split_batches(rows: DataFrame, valid: Column, done: str, failed: str, checkpoint: str, reason: Column | None = None) -> StreamingQuery:
    """Two outputs of one stream: rows that are ``valid`` under ``done``, all others (NULL too) with their ``reason`` under ``failed``.

    Each batch writes a folder of its own number in both places, over what an earlier try may have left there. So a batch that is run again
    after a failure writes no row twice, and every row is in one of the two.
    """
    fine = F.coalesce(valid, F.lit(False))
    why = reason if reason is not None else F.lit("invalid")

    def handle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.filter(fine).write.mode("overwrite").parquet(f"{done}/batch={number}")
        kept.filter(~fine).withColumn("reason", why).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        kept.unpersist()
    return catch_up_batches(rows, handle, checkpoint, "append")


def ingest_dedup(rows: DataFrame, keys: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Keep the first arrival per key; state expires with the watermark."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))
