"""Connected components of an edge table, by contraction.

Each round points every node at its smallest neighbour if that is smaller, follows the pointers to their roots by doubling, and
replaces the ends of every edge by their roots. At least every second node of a component goes away per round, so
there are logarithmically many rounds. Minima are combined before the shuffle; joins read written tables, so that
adaptive execution can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.storage import load, remove, save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    NULL ends and loops link nothing and are dropped; repeated edges count once. Without edges the result is empty.
    """
    spark = edges.sparkSession
    kept = edges.select(F.col("a"), F.col("b")).filter("a <> b")
    path = save(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found, found_path = None, None
    while True:
        left = load(spark, path)
        if left.isEmpty():
            return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
        roots_path = _roots(left)
        roots = load(spark, roots_path)
        if found is None:
            total = roots.select("node", F.col("parent").alias("component"))
        else:
            total = found.join(roots.select(F.col("node").alias("component"), "parent"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component"))
        total_path = save(total, "components")
        ends = (left.join(roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), "a")
                .join(roots.select(F.col("node").alias("b"), F.col("parent").alias("rb")), "b").filter("ra <> rb"))
        next_path = save(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        for old in (path, roots_path, found_path):
            if old:
                remove(spark, old)
        path, found_path, found = next_path, total_path, load(spark, total_path)


def _roots(edges: DataFrame) -> str:
    """Path of a table (node, parent) where every parent is a root."""
    spark = edges.sparkSession
    # edges.a < edges.b, so only b can have a smaller neighbour through this edge; roots point at themselves.
    smaller = edges.select(F.col("b").alias("node"), F.col("a").alias("parent")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("parent")))
    path = save(smaller.groupBy("node").agg(F.min("parent").alias("parent")), "parents")
    while True:
        now = load(spark, path)
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        jumped = now.join(up, "parent").select(
            "node", F.col("upper").alias("parent"), (F.col("upper") != F.col("parent")).alias("moved"))
        next_path = save(jumped, "parents")
        moved = not load(spark, next_path).filter("moved").isEmpty()
        remove(spark, path)
        path = next_path
        if not moved:
            return path
