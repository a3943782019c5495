"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources (``sources``, an array). Documents with the same set of sources form a pattern; what follows
works on the sizes of patterns. A flow routes token capacity from patterns to source quotas. A pattern offers its size once for free and again
at rising cost, up to ``MAX_COPIES`` times, so repeats are used last and are spread over patterns. Where a source is in no pattern
with others, its flow is its quota or all it can offer, which is a projection for any number of sources. Patterns that share sources,
directly or through others, form a component of their own, and each component's flow is found in one task, from a row for each pattern.

Then every pattern takes its documents in a seeded hash order: all of them as often as the flow covers the whole
pattern, and the first ones once more (or all but the first ones, if these are fewer) until the rest is used up. The place of the cut is
found by summing sizes over hash digits, one digit per pass. Where rows of equal hash stand at the cut, it goes on over the digits of a second hash,
of their saved number, until less than one document is open; then ``FILL`` passes add the largest document that still fits. Tables of patterns and
sources are broadcast up to ``ranking.BROADCAST_ROWS`` rows and joined by shuffle beyond.

Quotas: sources in code point order, NULL last, weigh 1, 2, 3, 1, 2, 3, ... and share the total size; no quota exceeds ``MAX_COPIES`` times its
source's size, the excess is shared again by weight.

* A document's size is its number of words; NULL text has none. Documents without words, sources of size zero: nothing is taken.
* NULL or empty ``sources`` count as the NULL source; repeated names count once. The draw depends on seed, id and text only; rows equal
  in these are interchangeable. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.components import connected_components
from sitegauge.llm.storage import saved
from sitegauge.operators.ranking import BROADCAST_ROWS, exact_rank

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 42
DIGIT_BITS = 10
DIGITS = 5
FILL = 6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """For a join by key: broadcast when ``rows`` prove few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def quotas(sizes: DataFrame, total: int, weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, size) with ``quota``: ``total`` shared by weight, none above ``most`` times its size.

    A source is full when its weighted share exceeds that. What full ones leave raises the share of the others, so a few passes
    over one row for each source settle which are full.
    """
    place = exact_rank(sizes, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = saved(place.select("source", "size", weight.alias("weight")), "weights")
    share, full = 0.0, -1
    while True:
        # One row: of those full at this share, number and what they take; the weight of the others.
        is_full = F.lit(share) * F.col("weight") > most * F.col("size")
        found = weighed.agg(F.count_if(is_full), F.sum(F.when(is_full, most * F.col("size")).otherwise(0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if found[0] == full or not found[2]:
            break
        full, share = found[0], (total - found[1]) / found[2]
    return weighed.select("source", "size", F.least(F.lit(share) * F.col("weight"), (most * F.col("size")).cast("double")).alias("quota"))


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, most: int = MAX_COPIES) -> list[int]:
    """Tokens to take from each pattern (sources, size) of a component so that quotas are met as far as possible, repeats costing most.

    Successive cheapest paths. The cost of a path is that of the copy it starts with, plus what it saves by moving flow between
    patterns; with costs 0, 1, 2, ... the next cheapest one comes from patterns that are least used.
    """
    flow = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    used = [0] * len(patterns)
    left = {s: int(round(q)) for s, q in quotas.items()}
    members: dict = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            members.setdefault(s, []).append(p)
    for tier in range(most):
        room = [min(size, (tier + 1) * size - u) for (_, size), u in zip(patterns, used)]
        # Within a tier all paths cost the same; a path may push flow of a source from one pattern to another source of it.
        waiting = [(len(patterns[p][0]), p) for p in range(len(patterns)) if room[p] > 0]
        heapq.heapify(waiting)
        while waiting:
            start = heapq.heappop(waiting)[1]
            while room[start] > 0:
                path = _augmenting(start, patterns, flow, left, members)
                if path is None:
                    break
                amount = min([room[start], left[path[-1][1]], *(flow[b][s] for (_, s), (b, _) in zip(path, path[1:]))])
                for i, (p, s) in enumerate(path):
                    flow[p][s] += amount
                    if i + 1 < len(path):
                        flow[path[i + 1][0]][s] -= amount
                left[path[-1][1]] -= amount
                room[start] -= amount
                used[start] += amount
    return used


def _augmenting(start: int, patterns: list, flow: list, left: dict, members: dict) -> list | None:
    """Steps (pattern, source) from ``start`` to a source with quota left, moving other patterns' flow on the way."""
    came: dict = {}
    seen_patterns, seen_sources, queue = {start}, set(), [start]
    for p in queue:
        for s in sorted(patterns[p][0], key=lambda x: (x is None, x or "")):
            if s in seen_sources:
                continue
            seen_sources.add(s)
            if left[s] > 0:
                path = [(p, s)]
                while path[0][0] != start:
                    path.insert(0, came[path[0][0]])
                return path
            for other in members[s]:
                if other not in seen_patterns and flow[other][s] > 0:
                    seen_patterns.add(other)
                    came[other] = (p, s)
                    queue.append(other)
    return None


def _flows(patterns: DataFrame, count: int, quota: DataFrame, sources: int, most: int) -> DataFrame:
    """``patterns`` (sources, names, size) with ``taken``, ``source_size`` and ``target``, sums over its sources."""
    shared = patterns.filter(F.size("names") > 1).select(F.explode("names").alias("source")).distinct()
    each = patterns.select("sources", "size", "names", F.explode("names").alias("source"))
    known = each.alias("e").join(_small(quota.withColumnRenamed("size", "source_size"), sources).alias("q"), F.col("e.source").eqNullSafe(F.col("q.source")))
    joined = saved(known.select("sources", "size", "names", "e.source", "source_size", "quota"), "patterns")
    summed = joined.groupBy("sources", "names", "size").agg(F.sum("source_size").alias("source_size"), F.sum("quota").alias("target"))
    alone = F.least(F.bround("target", 0).cast("bigint"), most * F.col("size"))
    if shared.isEmpty():
        return summed.select("*", alone.alias("taken"))
    # Sources of one pattern are linked; NULL is a source as well.
    number = F.coalesce(F.xxhash64("source"), F.lit(0))
    links = joined.select("sources", number.alias("b"), F.coalesce(F.xxhash64(F.element_at("names", 1)), F.lit(0)).alias("a")).filter("a <> b")
    parts = saved(connected_components(links), "parts")
    grouped = joined.withColumn("node", number).join(parts, "node")
    schema = "sources string, taken bigint"

    def solve(_: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["sources"], r["source"] is None, r["source"] or ""))
        members: dict[str, tuple[set, int]] = {}
        limits: dict = {}
        for r in rows:
            members.setdefault(r["sources"], (set(), r["size"]))[0].add(r["source"])
            limits[r["source"]] = r["quota"]
        taken = min_cost_flow([(frozenset(m), size) for m, size in members.values()], limits, most)
        return pa.table({"sources": pa.array(members.keys(), pa.string()), "taken": pa.array(taken, pa.int64())})
    solved = saved(grouped.groupBy("component").applyInArrow(solve, schema), "flows")
    return summed.join(_small(solved, count), "sources", "left").select(*summed.columns, F.coalesce("taken", alone).alias("taken"))


def _cut(rows: DataFrame, wanted: DataFrame, count: int, hashed: str = "draw") -> DataFrame:
    """Where each pattern's order of ``hashed`` passes ``open`` tokens: (pattern, bound = first hash not taken, open = tokens still open there)."""
    bits = DIGIT_BITS * DIGITS
    at = wanted.select("pattern", F.lit(0).cast("bigint").alias("bound"), "open")
    for digit in range(1, DIGITS + 1):
        inside = rows.join(_small(at, count), "pattern").filter(F.shiftright(hashed, bits - DIGIT_BITS * (digit - 1)) == F.col("bound"))
        sums = inside.groupBy("pattern", "open", F.shiftright(hashed, bits - DIGIT_BITS * digit).alias("next")).agg(F.sum("size").alias("size"))
        # At most 2^DIGIT_BITS sums per pattern.
        listed = sums.groupBy("pattern", "open").agg(F.array_sort(F.collect_list(F.struct("next", "size"))).alias("sums"))
        passed = F.aggregate("sums", F.struct(F.lit(-1).cast("bigint").alias("next"), F.col("open").alias("open")),
                             lambda a, x: F.when((a["next"] >= 0) | (x["size"] <= a["open"]), F.struct(
                                 a["next"].alias("next"), (a["open"] - F.when(a["next"] >= 0, F.lit(0).cast("bigint")).otherwise(x["size"])).alias("open")))
                             .otherwise(F.struct(x["next"].alias("next"), a["open"].alias("open"))))
        at = saved(listed.select("pattern", passed.alias("p")).select("pattern", F.col("p.next").alias("bound"), F.col("p.open").alias("open")), "cut")
    return at


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, pattern (JSON array of sources), source_size and target (sums over its sources), copies, taken."""
    names = F.array_sort(F.array_distinct("sources"))
    pattern = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.to_json(names, {"ignoreNullFields": "false"})).otherwise(F.lit("[null]"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 64 - DIGIT_BITS * DIGITS)
    rows = saved(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("size"),
                             pattern.alias("sources"), draw.alias("draw")), "sizes")
    patterns = saved(rows.groupBy("sources").agg(F.sum("size").alias("size")).withColumn("names", F.from_json("sources", "array<string>")), "sums")
    count, total = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    totals = saved(patterns.select(F.explode("names").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size")), "totals")
    sources, all_sizes = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Documents of several sources are in several totals; what is shared out is the size of the documents.
    quota = quotas(totals, all_sizes, weights, most)
    if total < all_sizes:
        quota = quota.withColumn("quota", F.col("quota") * F.lit(total / all_sizes))
    flows = _flows(patterns, count, quota, sources, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("taken") - F.col("whole") * F.col("size")
    # Where more than half is to be taken once more, the documents to leave out are drawn instead.
    numbered = saved(flows.withColumn("whole", whole).withColumn("rest", rest).select(
        "sources", F.monotonically_increasing_id().alias("pattern"), "whole", "source_size", "target", (2 * F.col("rest") > F.col("size")).alias("inverse"),
        F.when(F.col("rest") > 0, F.when(2 * F.col("rest") > F.col("size"), F.col("size") - F.col("rest")).otherwise(F.col("rest"))).alias("open")), "numbered")
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row")), 64 - DIGIT_BITS * DIGITS)
    known = rows.join(_small(numbered.drop("open"), count), "sources").withColumn("tie", tie)
    slim = known.select("pattern", "draw", "tie", "size", "row")
    cuts = _cut(slim, numbered.filter("open IS NOT NULL").select("pattern", "open"), count)
    # Rows of one hash, such as copies without an id, are told apart by their number.
    halved = cuts.filter("open > 0")
    equal = slim.join(_small(halved.select("pattern", "bound"), count), "pattern").filter("draw = bound").drop("bound")
    ties = _cut(equal, halved.select("pattern", "open"), count, "tie").select("pattern", F.col("bound").alias("tied"), F.col("open").alias("left"))
    state = saved(cuts.join(_small(ties, count), "pattern", "left").select(
        "pattern", "bound", F.coalesce("tied", F.lit(0)).alias("tied"), F.coalesce("left", "open").alias("open"),
        F.array().cast("array<bigint>").alias("more")), "state")
    for _ in range(FILL):
        open_ = state.filter("open > 0")
        if open_.isEmpty():
            break
        fits = slim.join(_small(open_, count), "pattern").filter(
            "(draw > bound OR draw = bound AND tie >= tied) AND size > 0 AND size <= open AND NOT array_contains(more, row)")
        best = fits.groupBy("pattern").agg(F.max(F.struct("size", (-F.col("draw")).alias("d"), (-F.col("row")).alias("r"))).alias("m"))
        state = saved(state.join(_small(best, count), "pattern", "left").select(
            "pattern", "bound", "tied", (F.col("open") - F.coalesce("m.size", F.lit(0))).alias("open"),
            F.when(F.col("m").isNotNull(), F.concat("more", F.array(-F.col("m.r")))).otherwise(F.col("more")).alias("more")), "state")
    chosen = known.join(_small(state.drop("open"), count), "pattern", "left")
    drawn = F.expr("draw < bound OR draw = bound AND tie < tied") | F.array_contains("more", F.col("row"))
    extra = F.coalesce((drawn != F.col("inverse")).cast("bigint"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0))
    return chosen.select("doc_id", "size", F.col("sources").alias("pattern"), "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))
