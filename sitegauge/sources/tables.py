"""Readers and writers for plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_META = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("energy_type", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("region", T.StringType()), T.StructField("country_code", T.StringType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV, told apart by the suffix. CSV needs a schema: no inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("reading CSV needs an explicit schema")
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write Parquet or CSV, with empty strings for NULL text in CSV."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def report_json(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document per row; NaN becomes null, as JSON has no NaN."""
    doubles = {f.name for f in df.schema.fields if f.dataType == T.DoubleType()}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    return df.select(*keys, F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def geojson_lines(df: DataFrame, ring: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row (newline-delimited, so files stay splittable)."""
    coordinates = F.array(F.transform(F.col(ring), lambda p: F.array(p["lon"], p["lat"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def attach_embeddings(meta: DataFrame, vectors: DataFrame, key: str = "index") -> DataFrame:
    """Vectors joined to their metadata by key."""
    return meta.join(vectors, key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows without a partner: an empty result proves the two sides align."""
    return left.join(right.select(key), key, "left_anti")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(key), key, "left_anti")


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to ``columns``; absent ones become empty strings."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in columns])


def of_type(df: DataFrame, energy_type: str) -> DataFrame:
    return df.filter(F.lower("energy_type") == energy_type.lower())


def blank_to_null(x: Column) -> Column:
    """Empty text means missing inside the engine."""
    return F.nullif(x, F.lit(""))
