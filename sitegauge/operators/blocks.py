"""Row blocks: the rows of a table as arrays, a few thousand rows to an element, for passes that add up per-model sums.

Iterative fits read the same rows many times. Their features are written once as blocks; a pass maps every block to a
partial sum of fixed size and adds these up along a tree, so the driver gets one sum whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.session import scratch_path

BLOCK_ROWS = 16_384
PARTITION_ROWS = 131_072   # fewer rows than this are not worth a task
FAN_IN = 16                # partial sums that meet in one place


def feature_array(df: DataFrame, features: str) -> Column:
    """Features as array<double>, from a vector or an array column."""
    kind = df.schema[features].dataType.typeName()
    return F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)


def write_blocks(rows: DataFrame, encode: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, int, int]:
    """Write (x array<double>, y, part, weight) as blocks; the table, its rows and its features.

    ``encode`` turns a float matrix into what is stored. Rows equal in all columns have equal ``key``.
    """
    spark = rows.sparkSession
    keyed = rows.select("x", F.col("y").cast("double").alias("y"), F.col("part").cast("int").alias("part"), F.col("weight").cast("double").alias("weight"),
                        F.xxhash64("x", "y", "part").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                n = part.num_rows
                matrix = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                stored = [encode(matrix)] + [part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([matrix.shape[1]], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in stored]],
                    names=["rows", "width", "x", "y", "part", "weight", "key"])
    path = scratch_path(spark, "blocks")
    keyed.mapInArrow(run, "rows long, width int, x binary, y binary, part binary, weight binary, key binary").write.parquet(path)
    table = spark.read.parquet(path)
    n, width = table.agg(F.sum("rows"), F.max("width")).first()
    return table, n or 0, width or 0


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores: what a join or a file leaves may be one partition, and a fit's passes follow its partitions."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


def partitions(table: DataFrame, rows: int, least: int | None = None) -> RDD:
    """The blocks as an RDD with no more partitions than rows are worth (``least`` rows each). An RDD, as the passes carry arrays as their state."""
    wanted = max(1, -(-rows // (least or PARTITION_ROWS)))
    return (table.coalesce(wanted) if table.rdd.getNumPartitions() > wanted else table).rdd


def total(parts: RDD) -> Any:
    """Sum of all elements (arrays of equal shape or lists of them)."""
    if parts.getNumPartitions() <= FAN_IN:
        return reduce(add, parts.collect())   # a sum for each partition
    return parts.treeReduce(add, depth=max(2, int(np.ceil(np.log(parts.getNumPartitions()) / np.log(FAN_IN)))))
