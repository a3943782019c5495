"""From raw documents to packed training sequences: the stages in order, each reading what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns of ``docs``.

* NULL and empty texts are scored like any other text; as empties are equal, one of them can stay.
* Rows that share an id count as one document in the near-duplicate and mixing stages: they stay or go, and are repeated, together.
* Without ``labels`` rows of both classes the classifier is a constant and keeps everything (0.5 for no labels at all).
* Empty tables pass through as empty tables. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import exact_dedup, mixing, packing, quality, simhash
from sitegauge.llm.storage import saved, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the raw documents, wherever it stands in the pipeline."""
    raw, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    name = unused(docs, "_score")
    scored = quality.score(docs, quality.fit(raw, labels), docs.columns, name)
    return scored.filter(F.col(name) >= quality.ACCEPT).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_unique(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, by shingles of five words and 128 bits."""
    found = simhash.near_groups(docs)
    groups = saved(found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")), "near")
    gone = groups.filter("NOT stays").select(F.col("doc_id").alias(unused(docs, "_gone")))
    # The joins with texts are of one form at every size: decisions grow with the documents.
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone[gone.columns[0]]), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
    key, copies, copy = (unused(docs, c) for c in ("_id", "_copies", "_copy"))
    wanted = saved(mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)), "copies").filter(F.col(copies) > 0)
    taken = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted[key]))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter), ("exact", exact_duplicates), ("near", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Models, hashes and token layouts have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
