"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into two segments. When two fingerprints differ in at most ``distance`` bits, they differ in at
most half of that in the first segment, or in at most the remainder less one in the second. So each distinct
fingerprint enumerates a small Hamming ball around each of its segments, looks the segment values up in the
table of all fingerprints, and every match is verified over all 64 bits. From a ball only the values not below its centre are probed, so
that a pair is found once. Verification is part of the join, so candidates are never emitted, only links.

``near_groups`` is the same search with more bits, for copies with more changes: a second word of 64 bits from another seed, three
segments for each word, a search that either word may win, and all 128 bits verified. Its look-ups run in numpy, group by group. There, nodes first join the smallest one of an equal segment, and pairs within what is joined so make no links.

* Words are runs of characters other than space and tab to carriage return; A-Z is lower-cased. A text with fewer words than
  a shingle has is one shingle; without words (or NULL) its fingerprint is zero, linked like any other.
* Equal fingerprints collapse before the search: copies cost nothing and hot groups never meet as rows.
* NULL ids take part; a component's id is its smallest non-NULL one. Repeated rows stay. Empty tables give empty results. Extra
  columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.components import connected_components
from sitegauge.llm.storage import load, save, saved

DISTANCE = 4
SHINGLE = 4
SEED = 42
FIRST_BITS = 28

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return fingerprint_words(text, shingle, 1)[0]


def fingerprint_words(text: str | None, shingle: int, count: int) -> list[int]:
    """``count`` unsigned 64-bit words; each is a fingerprint by a seed of its own."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return [0] * count
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    return [_majority([joined[a:b] for a, b in zip(starts, stops)], SEED + k) for k in range(count)]


def _majority(shingles: list[bytes], seed: int) -> int:
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(x, seed) for x in shingles], "<u8")
    votes = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def links(prints: DataFrame, distance: int = DISTANCE, first_bits: int = FIRST_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most ``distance`` bits."""
    near = distance // 2
    mask = (1 << first_bits) - 1
    first = F.col("fingerprint").bitwiseAND(F.lit(mask))
    second = F.shiftrightunsigned("fingerprint", first_bits)
    tag = 1 << 62  # tells values of the second segment from those of the first

    def probes(value, bits: int, radius: int, mark: int):
        ball = prints.select(F.col("fingerprint").alias("a"), value.alias("centre"), F.explode(F.lit(_ball(bits, radius))).alias("flips"))
        probe = F.col("centre").bitwiseXOR(F.col("flips"))
        return ball.filter(probe >= F.col("centre")).select("a", probe.bitwiseXOR(F.lit(mark)).alias("value"))

    asked = probes(first, first_bits, near, 0)
    held = prints.select(F.col("fingerprint").alias("b"), first.alias("value"))
    if distance > near:
        asked = asked.unionByName(probes(second, 64 - first_bits, distance - near - 1, tag))
        held = held.unionByName(prints.select(F.col("fingerprint").alias("b"), second.bitwiseXOR(F.lit(tag)).alias("value")))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    in_first = F.bit_count(differ.bitwiseAND(F.lit(mask)))
    from_first = F.col("value").bitwiseAND(F.lit(tag)) == 0
    # Pairs within reach of the first segment are left to it. At the centre of a ball both sides probe: one order counts.
    once = F.when(from_first, (in_first > 0) | (F.col("a") < F.col("b"))).otherwise(
        (in_first > near) & ((in_first < F.bit_count(differ)) | (F.col("a") < F.col("b"))))
    return (asked.alias("p").join(held.hint("shuffle_hash").alias("t"), "value")
            .filter((F.bit_count(differ) <= distance) & (F.col("a") != F.col("b")) & once).select("a", "b"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprints as signed longs."""
    spark = docs.sparkSession
    rows = load(spark, save(fingerprints(docs), "fingerprints"))
    distinct = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "distinct")
    parts = connected_components(links(distinct.select("fingerprint"), distance))
    rooted = distinct.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "doc_id", F.coalesce("component", "fingerprint").alias("root"))
    rooted = saved(rooted, "rooted")
    # Written, so that both sides of the join are dealt anew and a crowded root can be split.
    smallest = saved(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    named = saved(rooted.join(smallest, "root").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


WORDS = 2
GROUP_SHINGLE = 5
GROUP_DISTANCE = 8      # in one of the words
GROUP_COMPLETE = 22     # in all words together
GROUP_SEGMENTS = 3      # long ones meet fewer strangers; the links are the same with any number


def _segments(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius): words within ``distance`` are within the radius in one segment at least."""
    width, wider = divmod(64, segments)
    near, more = divmod(distance, segments)
    out, first = [], 0
    for k in range(segments):
        bits = width + (k < wider)
        out.append((first, bits, near if k <= more else near - 1))
        first += bits
    return [x for x in out if x[2] >= 0]


def _within(distance: int, complete: int, words: int):
    """Condition on columns a0, a1, ... and b0, b1, ...: near in some word, and in all together."""
    apart = [F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(words)]
    return reduce(lambda x, y: x | y, [x <= distance for x in apart]) & (reduce(lambda x, y: x + y, apart) <= complete)


def _value(place: int, w: int, first: int, bits: int):
    return F.shiftrightunsigned(f"w{w}", first).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(place << 56)


def star_links(nodes: DataFrame, distance: int = GROUP_DISTANCE, complete: int = GROUP_COMPLETE, segments: int = 4, words: int = WORDS) -> DataFrame:
    """Links (a, b) of each node to the smallest one that has an equal segment, where these are near: some of all links, never many."""
    places = [(w, *segment) for w in range(words) for segment in _segments(distance, segments)]
    values = F.array(*[_value(k, w, first, bits) for k, (w, first, bits, _) in enumerate(places)])
    each = nodes.select("node", *[F.col(f"w{w}").alias(f"b{w}") for w in range(words)], F.explode(values).alias("value"))
    least = each.groupBy("value").agg(F.min(F.struct("node", *[F.col(f"b{w}") for w in range(words)])).alias("least"), F.count(F.lit(1)).alias("n"))
    centre = saved(least.filter("n > 1").select("value", F.col("least.node").alias("a"), *[F.col(f"least.b{w}").alias(f"a{w}") for w in range(words)]), "centres")
    met = each.join(centre.hint("merge"), "value").filter((F.col("a") != F.col("node")) & _within(distance, complete, words))
    return met.select("a", F.col("node").alias("b"))


GROUP_NODES = 1 << 16   # about so many nodes of one segment lie in a group
PREFIX_BITS = 4         # at least: groups for every task
CANDIDATES = 1 << 20    # look-ups and pairs that a task makes at once
LONG_SLICE = 8


def _met(low: np.ndarray, asks: np.ndarray, node: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking row, held row) of different nodes whose ``low`` bits differ in few places, a part at a time, each once.

    ``asks`` is the number of bits in which a row's prefix differs from the group's. Rows of the group's own prefix are held, sorted by value: those
    of one value are a slice. In long slices the asking row's own node is cut out, as it needs no links within.
    """
    rank = np.unique(node, return_inverse=True)[1]
    key = low * len(low) + rank
    held = np.flatnonzero(asks == 0)
    held = held[np.argsort(key[held])]
    held_key, counts = key[held], np.bincount(low[held], minlength=1 << bits)
    starts = np.cumsum(counts) - counts
    for apart in range(radius + 1):
        flips, rows = np.array(_ball(bits, radius - apart), np.int64), np.flatnonzero(asks == apart)
        for first in range(0, len(rows), step := max(1, CANDIDATES // len(flips))):
            part = rows[first:first + step]
            values = low[part][:, None] ^ flips
            found = counts[values]
            if apart == 0:
                found[values < low[part][:, None]] = 0      # there the other row asks
            hit = np.flatnonzero(found)
            row, value, size = part[hit // len(flips)], values.ravel()[hit], found.ravel()[hit]
            at, long = starts[value], size > LONG_SLICE
            own = value[long] * len(low) + rank[row[long]]
            left, right, end = np.searchsorted(held_key, own), np.searchsorted(held_key, own, "right"), at[long] + size[long]
            size[long] = left - at[long]
            row, at, size = np.r_[row, row[long]], np.r_[at, right], np.r_[size, end - right]
            total = np.cumsum(size)
            cuts = np.searchsorted(total, np.arange(CANDIDATES, total[-1] if len(total) else 0, CANDIDATES))
            for some in np.split(np.arange(len(row)), np.unique(cuts)):
                n = size[some]
                a = np.repeat(row[some], n)
                b = held[np.repeat(at[some] - (np.cumsum(n) - n), n) + np.arange(len(a))]
                yield a, b


def word_links(nodes: DataFrame, distance: int = GROUP_DISTANCE, complete: int = GROUP_COMPLETE, segments: int = 4,
               words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, w0, w1, ...) within ``distance`` in some word and within ``complete`` in all; each pair once.

    A node travels only by flips of a segment's first bits, to the groups whose prefix is not below its own; flips of the others are
    look-ups inside the group. One job counts the nodes while the plan is built: prefixes get longer with them, so groups do not grow.
    """
    places = [(w, *segment) for w in range(words) for segment in _segments(distance, segments)]
    prefix = min(max(PREFIX_BITS, (nodes.count() // GROUP_NODES).bit_length()), 64 // segments - 1)
    names = [f"w{w}" for w in range(words)]

    def sent(k: int, w: int, first: int, bits: int, radius: int) -> DataFrame:
        own = F.shiftrightunsigned(f"w{w}", first + bits - prefix).bitwiseAND(F.lit((1 << prefix) - 1))
        ball = nodes.select("node", *names, own.alias("own"), F.explode(F.lit(_ball(prefix, radius))).alias("flips"))
        probe = F.col("own").bitwiseXOR(F.col("flips"))
        return ball.filter(probe >= F.col("own")).select((probe + F.lit(k << 56)).alias("group"), "node", *names)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        k, there = divmod(key[0].as_py(), 1 << 56)
        w, first, bits, radius = places[k]
        node, values = rows.column("node").to_numpy(), [rows.column(c).to_numpy().view(np.uint64) for c in names]
        segment = (values[w] >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        rest = bits - prefix
        low, asks = segment & ((1 << rest) - 1), np.bitwise_count((segment >> rest) ^ there)
        found = [(node[:0], node[:0])]
        for a, b in _met(low, asks, node, rest, radius):
            near = np.flatnonzero(np.bitwise_count(values[w][a] ^ values[w][b]) <= distance)
            a, b = a[near], b[near]
            # Equal values find each other from both sides.
            once = (node[a] != node[b]) & ((asks[a] > 0) | (low[a] != low[b]) | (a < b))
            a, b = a[once], b[once]
            differ = [v[a] ^ v[b] for v in values]
            apart = [np.bitwise_count(d).astype(np.int64) for d in differ]
            kept = sum(apart) <= complete
            for v, start, width, most in places[:k]:    # the first place that finds a pair reports it
                inside = np.bitwise_count(differ[v] >> np.uint64(start) & np.uint64((1 << width) - 1))
                kept &= (inside > most) | (apart[v] > distance)
            found.append((node[a[kept]], node[b[kept]]))
        return pa.table([np.concatenate(side) for side in zip(*found)], names=["a", "b"])
    everything = reduce(DataFrame.unionByName, [sent(k, *place) for k, place in enumerate(places)])
    return everything.groupBy("group").applyInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, shingle: int = GROUP_SHINGLE, distance: int = GROUP_DISTANCE, complete: int = GROUP_COMPLETE) -> DataFrame:
    """(doc_id, component_id) for every row; the component's id is its smallest non-NULL one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_words(t.as_py(), shingle, WORDS) for t in batch.column(1)], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, w]) for w in range(WORDS)]], names=["doc_id", "w0", "w1"])
    rows = saved(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, w0 bigint, w1 bigint"), "words")
    nodes = saved(rows.groupBy("w0", "w1").agg(F.min("doc_id").alias("smallest")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    settings = (distance, complete, GROUP_SEGMENTS)
    # Copies of one text are near each other, all with all. What stars join first needs no links within it.
    stars = saved(connected_components(star_links(nodes.select("node", "w0", "w1"), *settings)), "stars")
    joined = saved(nodes.join(stars, "node", "left").select("w0", "w1", "smallest", F.coalesce("component", "node").alias("node")), "joined")
    parts = connected_components(word_links(joined.select("node", "w0", "w1"), *settings))
    # A star that meets no other keeps its own number.
    alone = stars.select(F.col("component").alias("node")).distinct().join(parts, "node", "left_anti")
    parts = saved(parts.unionByName(alone.withColumn("component", F.col("node"))), "parts")
    linked = saved(joined.join(parts, "node").select("w0", "w1", "smallest", "component"), "linked")
    least = saved(linked.groupBy("component").agg(F.min("smallest").alias("component_id")), "least")
    named = saved(nodes.select("w0", "w1", "smallest").join(linked.join(least, "component").select("w0", "w1", "component_id"), ["w0", "w1"], "left").select(
        "w0", "w1", F.coalesce("component_id", "smallest").alias("component_id")), "named")
    return rows.join(named, ["w0", "w1"]).select("doc_id", "component_id")
