"""Intermediate tables in the shared folder, so that a lost executor never loses work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sitegauge.session import scratch_path


def saved(df: DataFrame, label: str, partition_by: Sequence[str] = (), codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and read it back with the same schema."""
    return load(df.sparkSession, save(df, label, partition_by, codec), df.schema)


def save(df: DataFrame, label: str, partition_by: Sequence[str] = (), codec: str = "zstd") -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    return path


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no remaining plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the next longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
