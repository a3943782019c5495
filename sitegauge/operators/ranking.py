"""Exact ranks, running sums and keep-first that survive hot groups.

A third of all rows may share one group, so no operator here sends a whole
group to one task: extremes are pre-aggregated before the shuffle, top-n works
on salted sub-groups first, and full orders use range partitions plus offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import durable


BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A derived table for a keyed join: broadcast when it proves to have at most ``most`` rows, else joined by shuffle.

    The table is materialised before it is counted, so the check costs no second pass.
    """
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def _named(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` (which must be unique within a key).

    ``min_by`` is combined on the map side, so copies of one key collapse
    before they are shuffled.
    """
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int | Column,
          rank_name: str | None = None) -> DataFrame:
    """Rows ranked 1..n per group; ``order`` must be total within a group.

    Each group is first cut down inside salted sub-groups. A row of the final
    top n is in the top n of its sub-group as well, so nothing is lost, and the
    second pass sees at most n rows per sub-group.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = F.lit(n) if isinstance(n, int) else n
    rank = rank_name or "_rank"
    sort = _named(order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*sort)
    whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*sort)
    survivors = salted.withColumn("_local", F.row_number().over(part)).filter(F.col("_local") <= limit)
    ranked = survivors.drop("_salt", "_local").withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)
    return ranked if rank_name else ranked.drop(rank)


def _hashable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                   sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums along ``order`` within each group.

    The rows are range-partitioned on (group, order). Each slice sums its own
    rows, and a small table of slice totals gives the offset of every slice, so
    a group of any size is spread over many tasks. The slices are checkpointed
    because both passes must see the same boundaries even after a task is lost.
    """
    sort = _named(order)
    # A struct compares NULL parts as equal, so NULL groups keep their rows.
    key = F.struct(*group) if group else F.lit(0)
    slices = durable(
        df.select("*", key.alias("_grp"), *[expr.alias(f"_v_{name}") for name, expr in sums.items()])
        .repartitionByRange(*[F.col(g) for g in group], *sort)
        .withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy("_grp").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = slices.groupBy("_grp", "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select("_grp", "_slice", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_grp", "_slice").orderBy(*sort).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = slices.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    joined = local.join(offsets, ["_grp", "_slice"])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def exact_rank(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Row number (from 1) within a group of any size."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")})


def hash_cuts(df: DataFrame, group: str, u: str, key: str, ranks: Column) -> DataFrame:
    """Rows at given ranks of a hash order: (group, cut = array of (u, key) in order).

    ``u`` is uniform in [0, 2^32) and ``ranks`` an array computed from ``n``, the
    size of the group. A histogram of the leading bits locates the bucket of every
    rank; only rows of those buckets are ordered. Nothing is sorted as a whole.
    ``group`` must have few values (classes), as the result has one row for each.
    """
    slim = df.select(F.col(group), F.col(u).alias("_u"), F.col(key).alias("_k"),
                     F.shiftright(F.col(u), HASH_BUCKET_SHIFT).alias("_b"))
    order = Window.partitionBy(group).orderBy("_b")
    counts = slim.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.select(group, "_b", "_c", F.sum("_c").over(order).alias("_to"),
                         F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    start = F.col("_to") - F.col("_c")
    wanted = F.filter(ranks, lambda r: (r > start) & (r <= F.col("_to")))
    buckets = upto.select(group, "_b", F.transform(wanted, lambda r: r - start).alias("_places")).filter(F.size("_places") > 0)
    # At most one bucket per rank and class.
    near = slim.join(lookup(buckets), [group, "_b"])
    placed = near.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_u", "_k")))
    hits = placed.filter(F.array_contains("_places", F.col("_place").cast("bigint")))
    return hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_u", "_k"))).alias("cut"))


HASH_BUCKET_SHIFT = 16   # 65 536 buckets


def first_in_order(df: DataFrame, group: str, position: Column, key: str, goal: Column, shift: int) -> DataFrame:
    """The first ``goal`` rows of each group along (position, key), for goals that may grow with the group.

    ``position`` is a non-negative integer, ``goal`` constant within a group and ``group`` has few values. Rows are counted
    per bucket of ``2 ** shift`` positions; only the bucket in which the goal is reached is ordered. All other
    rows are compared with the cut found there, so no window or task sees a whole group.
    """
    placed = df.select("*", position.cast("bigint").alias("_at"), goal.cast("bigint").alias("_rows"))
    slim = placed.select(group, "_rows", "_at", F.col(key).alias("_k"), F.shiftright("_at", shift).alias("_b"))
    counts = slim.groupBy(group, "_rows", "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(group).orderBy("_b")))
    edge = upto.filter((F.col("_to") >= F.col("_rows")) & (F.col("_to") - F.col("_c") < F.col("_rows")))
    # At most one bucket, and then one cut, per group.
    near = slim.join(F.broadcast(edge.select(group, "_b", (F.col("_rows") - F.col("_to") + F.col("_c")).alias("_want"))), [group, "_b"])
    order = Window.partitionBy(group, "_b").orderBy("_at", "_k")
    cut = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == F.col("_want")).select(
        group, F.struct("_at", "_k").alias("_cut"))
    joined = placed.join(F.broadcast(cut), group, "left")
    inside = F.col("_cut").isNull() | (F.struct(F.col("_at"), F.col(key).alias("_k")) <= F.col("_cut"))
    return joined.filter(inside & (F.col("_rows") > 0)).select(*df.columns)
