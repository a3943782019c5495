"""Exact ranks and keep-first against pandas, with one group holding most rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitegauge.operators.ranking import exact_rank, keep_first, running_totals, top_n
from sitegauge.session import shared_root


def _skewed(spark, n=3000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 9, F.lit(None)).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), (F.xxhash64("id") % 50).alias("v"))


def _pandas_rank(pdf):
    return pdf.sort_values(["v", "id"]).groupby("g", dropna=False).cumcount() + 1


def test_exact_rank(spark):
    df = _skewed(spark)
    got = exact_rank(df, ["g"], ["v", "id"]).toPandas().set_index("id")["rank"].sort_index()
    pdf = df.toPandas()
    want = pdf.assign(rank=_pandas_rank(pdf)).set_index("id")["rank"].sort_index()
    assert (got == want).all() and len(got) == len(want)


def test_exact_rank_over_many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_exact_rank(spark)
        whole = exact_rank(_skewed(spark), [], [F.col("v").desc(), "id"]).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
        assert tuple(whole) == (1, 3000, 3000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals(spark):
    df = _skewed(spark)
    got = running_totals(df, ["g"], ["v", "id"], {"s": F.col("v")}).toPandas().set_index("id")["s"].sort_index()
    pdf = df.toPandas().sort_values(["v", "id"])
    want = pdf.assign(s=pdf.groupby("g", dropna=False)["v"].cumsum()).set_index("id")["s"].sort_index()
    assert (got == want).all()


def test_top_n(spark):
    df = _skewed(spark)
    pdf = df.toPandas()
    want = set(pdf.assign(r=_pandas_rank(pdf)).query("r <= 7")["id"])
    assert {r["id"] for r in top_n(df, ["g"], ["v", "id"], 7).collect()} == want
    by_column = top_n(df.withColumn("k", F.lit(7)), ["g"], ["v", "id"], F.col("k"), "r")
    assert {r["id"] for r in by_column.collect()} == want


def test_keep_first(spark):
    df = _skewed(spark)
    got = {(r["g"], r["id"]) for r in keep_first(df, ["g"], ["v", "id"]).select("g", "id").collect()}
    pdf = df.toPandas()
    first = pdf.assign(r=_pandas_rank(pdf)).query("r == 1")
    assert got == {(None if pd.isna(g) else g, i) for g, i in zip(first["g"], first["id"])}
    again = df.union(df)
    assert keep_first(again, ["g"], ["v", "id"]).count() == len(got)


class _Session:
    """Just the two settings that decide about the shared folder."""

    def __init__(self, configured=None, current=None, master="yarn"):
        self.conf = {"spark.checkpoint.dir": configured}
        self.sparkContext = type("Context", (), {"getCheckpointDir": lambda _: current, "master": master})()


def test_checkpoint_folder_comes_from_the_session():
    assert shared_root(_Session("hdfs:///shared", "/old")) == "hdfs:///shared"
    assert shared_root(_Session(None, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError):
        shared_root(_Session())
