"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Equal vectors collapse to one node that lists its smallest ids, one more than neighbours wanted (a larger one can't be among the nearest), so copies
neither fill neighbour lists nor meet in one task. Nodes are dealt by hash into shards of about ``SHARD`` nodes; a shard's graph is one row:
flat neighbour arrays per layer, padded with -1. Every distinct query vector is searched in every shard of its length, in blocks of about
``QUERY_BLOCK`` queries, and the shards' results are merged.

For the graph, vectors get one more component that makes all of a shard equally long, so that the largest inner product is
the smallest distance. Scores are inner products of the original vectors in double precision, summed in the same order for all.

* Vectors that are NULL, zero or hold NULL or non-finite components take no part, neither do rows without an id. Vectors of different lengths
  never meet. Fewer candidates than wanted: all are returned. Ties go to the smaller id. Rows that repeat an id count once per
  vector. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.storage import saved

NEIGHBOURS = 16          # links of a new node; twice as many are kept in the lowest layer
BUILD_WIDTH = 64
SEARCH_WIDTH = 320
SHARD = 16_384
QUERY_BLOCK = 2_048
TOP = 20


class Graph:
    """The graph of one shard, as flat arrays."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray], entry: int):
        self.vectors = vectors
        norms = (vectors ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))
        self.lifted = np.hstack([vectors, lift[:, None]]).astype(np.float32)
        self.layers, self.members, self.entry = layers, members, entry
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        """Insert all vectors one by one. ``layers[l]`` has a row per node of the layer, ``members[l]`` the nodes' numbers."""
        n, m = len(vectors), NEIGHBOURS
        heights = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 12)
        members = [np.flatnonzero(heights >= level) for level in range(int(heights.max(initial=0)) + 1)]
        # Rows have room for as many links again, so that a full row is thinned out only now and then.
        layers = [np.full((len(nodes), 4 * m if level == 0 else 2 * m), -1, np.int32) for level, nodes in enumerate(members)]
        graph = cls(vectors, layers, members, -1)
        graph.rows = [dict(zip(nodes.tolist(), range(len(nodes)))) for nodes in members]
        graph.counts = [np.zeros(len(nodes), np.int64) for nodes in members]
        top = -1
        for node in range(n):
            height = int(heights[node])
            if top < 0:
                graph.entry, top = node, height
                continue
            point, start = graph.lifted[node], graph.entry
            for level in range(top, height, -1):
                start = graph._search(point, [start], 1, level)[0][1]
            starts = [start]
            for level in range(min(top, height), -1, -1):
                near = graph._search(point, starts, BUILD_WIDTH, level)
                starts = [i for _, i in near]
                graph._link(node, graph._diverse(node, np.array(starts), m), level)
            if height > top:
                graph.entry, top = node, height
        for level, keep in ((level, 2 * m if level == 0 else m) for level in range(len(layers))):
            for row in np.flatnonzero(graph.counts[level] > keep):
                graph._thin(level, row, keep)
            layers[level] = layers[level][:, :keep].copy()
        return graph

    def _row(self, level: int, node: int) -> int:
        if level == 0:
            return node
        return self.rows[level][node]

    def _diverse(self, node: int, near: np.ndarray, keep: int) -> np.ndarray:
        """Of the candidates, nearest first, those nearer to ``node`` than to one already chosen; the nearest others fill up."""
        if len(near) <= keep:
            return near
        points = self.lifted[near]
        between, own = points @ points.T, points @ self.lifted[node]
        order = np.argsort(-own, kind="stable")
        nearest = np.full(len(near), -np.inf, np.float32)
        chosen: list[int] = []
        for i in order.tolist():
            if own[i] > nearest[i]:
                chosen.append(i)
                if len(chosen) == keep:
                    break
                np.maximum(nearest, between[i], out=nearest)
        if len(chosen) < keep:
            taken = set(chosen)
            chosen += [i for i in order.tolist() if i not in taken][:keep - len(chosen)]
        return near[chosen]

    def _thin(self, level: int, row: int, keep: int) -> None:
        links = self.layers[level][row]
        node = int(self.members[level][row])
        kept = self._diverse(node, links[:self.counts[level][row]], keep)
        links[:] = -1
        links[:len(kept)] = kept
        self.counts[level][row] = len(kept)

    def _link(self, node: int, near: np.ndarray, level: int) -> None:
        table, counts = self.layers[level], self.counts[level]
        row = self._row(level, node)
        table[row, :len(near)] = near
        counts[row] = len(near)
        for other in near.tolist():
            at = self._row(level, other)
            if counts[at] == table.shape[1]:
                self._thin(level, at, table.shape[1] // 2)
            table[at, counts[at]] = node
            counts[at] += 1

    def _search(self, point: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The best (similarity, node) found in a layer, best first."""
        self.turn += 1
        seen, turn, table, lifted = self.seen, self.turn, self.layers[level], self.lifted
        first = np.unique(np.array(starts))
        seen[first] = turn
        sims = lifted[first] @ point
        best = list(zip(sims.tolist(), first.tolist()))
        ahead = [(-s, i) for s, i in best]
        heapq.heapify(best)
        heapq.heapify(ahead)
        while len(best) > width:
            heapq.heappop(best)
        while ahead:
            s, node = heapq.heappop(ahead)
            if -s < best[0][0] and len(best) >= width:
                break
            near = table[self._row(level, node)]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            sims = lifted[near] @ point
            if len(best) >= width:
                better = sims > best[0][0]
                near, sims = near[better], sims[better]
            for s, i in zip(sims.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(ahead, (-s, i))
        return sorted(best, reverse=True)

    def search(self, query: np.ndarray, width: int) -> np.ndarray:
        """Numbers of up to ``width`` nodes with large inner products."""
        point = np.append(query, 0).astype(np.float32)
        starts = [self.entry]
        for level in range(len(self.layers) - 1, 0, -1):
            starts = [self._search(point, starts, 1, level)[0][1]]
        return np.array([i for _, i in self._search(point, starts, width, 0)])


_SHARD = ("length int, shard int, nodes int, entry int, vectors binary, ids array<array<bigint>>, heights array<int>, links array<binary>")


def _build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    length, shard = key[0].as_py(), key[1].as_py()
    group = group.sort_by("vec_id")
    vectors = np.array(group["vector"].to_pylist(), np.float64).reshape(-1, length)
    graph = Graph.build(vectors)
    return pa.table({
        "length": pa.array([length], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": pa.array([len(vectors)], pa.int32()),
        "entry": pa.array([graph.entry], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "ids": pa.array([group["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
        "heights": pa.array([np.sum([np.isin(np.arange(len(vectors)), m) for m in graph.members], axis=0).tolist()], pa.list_(pa.int32())),
        "links": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary()))})


def _load(row: dict) -> Graph:
    """The graph from its flat arrays; ``heights`` counts the layers a node is in."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["nodes"], row["length"])
    heights = np.array(row["heights"])
    members = [np.flatnonzero(heights > level) for level in range(len(row["links"]))]
    layers = [np.frombuffer(x, np.int32).reshape(len(m), -1) for x, m in zip(row["links"], members)]
    graph = Graph(vectors, layers, members, row["entry"])
    graph.rows = [dict(zip(m.tolist(), range(len(m)))) if level else {} for level, m in enumerate(members)]
    return graph


_FOUND = "query bigint, found array<struct<score:double,vec_id:bigint>>"


def _search_block(top: int, width: int):
    def run(key: tuple[pa.Scalar, ...], shards: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if shards.num_rows and queries.num_rows:
            row = shards.to_pylist()[0]
            graph, ids = _load(row), row["ids"]
            for query in queries.to_pylist():
                vector = np.array(query["vector"], np.float64)
                near = graph.search(vector, max(width, top))
                scores = (graph.vectors[near] * vector).sum(axis=1)
                order = np.lexsort((near, -scores))[:top]
                found = [(-float(scores[i]), v) for i in order for v in ids[near[i]]]
                out.append({"query": query["query"], "found": [{"score": -s, "vec_id": v} for s, v in sorted(found)[:top]]})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("query", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))]))
    return run


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Shards as rows of a written table."""

    def __init__(self, shards: DataFrame, top: int):
        self.shards, self.top = shards, top


def build_index(vectors: DataFrame, top: int = TOP, shard: int = SHARD) -> Index:
    """Index over (vec_id, vector) that can return ``top`` neighbours."""
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
        "vec_id", F.col("vector").cast("array<double>").alias("vector")).distinct()
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = clean.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top + 1)
    nodes = saved(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        "vector", "ids", F.get("ids", F.lit(0)).alias("vec_id"), F.size("vector").alias("length")), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    built = dealt.repartition(shards, "length", "shard").groupBy("length", "shard").applyInArrow(_build, _SHARD)
    return Index(saved(built, "graphs"), top)


def search(index: Index, queries: DataFrame, width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK) -> DataFrame:
    """Neighbours of ``queries`` (vec_id, vector), a query's own id excepted: query_id, rank, vec_id, score."""
    asked = saved(queries.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
        "vec_id", F.col("vector").cast("array<double>").alias("vector")).distinct(), "asked")
    distinct = saved(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "queries")
    blocks = max(1, -(-distinct.count() // block))
    # Every query goes to every shard of its length: queries x shards rows, which is what merging shard results takes.
    places = index.shards.select(F.col("length").alias("length"), F.col("shard").alias("shard"))
    sent = distinct.withColumn("length", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).join(
        places, "length")
    served = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = served.groupBy("length", "shard", "block").cogroup(sent.groupBy("length", "shard", "block")).applyInArrow(
        _search_block(index.top + 1, width), _FOUND)
    ordered = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id")))
    merged = saved(found.groupBy("query").agg(F.slice(F.array_sort(ordered), 1, index.top + 1).alias("near")), "merged")
    named = asked.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, index.top)
    return (named.join(merged, "query").select("query_id", F.posexplode(others).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")))
