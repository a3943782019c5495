"""Exact duplicates through a minimal perfect hash over the distinct digests seen before.

The history is grouped by digest once (copies collapse before the shuffle); every group's winner is the row with the most code points,
then the smallest id. The distinct digests are dealt into shards of about ``SHARD`` and each shard gets a minimal
perfect hash: levels of bit arrays in which a key owns a bit when no other key of its level maps there; the rank of the bit is the slot.
Slots hold the full digest and the winner. As a minimal perfect hash sends strangers to arbitrary slots, every lookup
compares all 32 bytes. Rows found in the history are repeats; the others are grouped among themselves by an index of their own.

Rows meet their shard in a sorted stream: the shard's index comes first, rows follow in batches of bounded size. A shard with many rows
is served by several tasks (one per ``SALT_ROWS`` rows), each with its copy of the index, so a text that is a third of the
table is looked up in parallel. Only digests and lengths travel, never texts.

* NULL text counts as empty. Rows are told apart by a row number, so exactly one of several identical rows is kept; NULL ids lose against
  others. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.storage import saved, unused

SHARD = 16_384
SALT_ROWS = 65_536
LOAD = 1.5      # bits of a level per key that reaches it
LEVELS = 64     # a key survives a level with probability below one half

WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_chars, digest) of every row, written once: texts are read only here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return saved(docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                             F.length(text).cast("bigint").alias("n_chars"), digest(F.col("text")).alias("digest")), "digests")


def _mixed(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of every key (n x 4 words) in a level of ``size`` bits."""
    x = keys[:, level % 4] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct 32-byte keys to 0..n-1; other keys to any of these or to -1."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        self.levels, self.ranks, first = [], [], 0
        for size in sizes:
            width = (size + 7) // 8
            level = np.unpackbits(np.frombuffer(bits, np.uint8, width, first), count=size, bitorder="little")
            first += width
            before = int(self.ranks[-1][-1]) if self.ranks else 0
            self.levels.append(level.astype(bool))
            self.ranks.append(before + np.concatenate([[0], np.cumsum(level, dtype=np.int64)]))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(8, int(LOAD * len(keys)))
            at = _mixed(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").tobytes())
            keys = keys[~alone[at]]
        return cls(sizes, b"".join(parts))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for n, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _mixed(keys[left], n, len(level))
            hit = level[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return found


def _words(column: pa.Array) -> np.ndarray:
    """32-byte digests as an n x 4 array of unsigned 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


_INDEX = ("shard int, rows bigint, sizes array<int>, bits binary, digests binary, keep_ids array<bigint>, "
          "keep_rows array<bigint>, group_sizes array<bigint>")


def _build_shard(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    keys = _words(group["digest"].combine_chunks())
    perfect = PerfectHash.build(keys)
    order = np.argsort(perfect.slots(keys))
    ordered = group.take(pa.array(order))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sum(group["group_size"].to_pylist())], pa.int64()),
        "sizes": pa.array([perfect.sizes], pa.list_(pa.int32())), "bits": pa.array([perfect.bits], pa.binary()),
        "digests": pa.array([keys[order].tobytes()], pa.binary()),
        "keep_ids": pa.array([ordered["keep_id"].to_pylist()], pa.list_(pa.int64())),
        "keep_rows": pa.array([ordered["keep_row"].to_pylist()], pa.list_(pa.int64())),
        "group_sizes": pa.array([ordered["group_size"].to_pylist()], pa.list_(pa.int64()))})


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


class Index:
    """A written table with one row per shard, and the number of shards."""

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards


def build_index(history: DataFrame) -> Index:
    """Index over the digest rows of ``digests()``."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = saved(history.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    shards = max(1, -(-groups.count() // SHARD))
    built = groups.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(_build_shard, _INDEX)
    return Index(saved(built, "perfect-hash"), shards)


_FOUND = "doc_id bigint, row bigint, n_chars bigint, digest binary, member boolean, keep_id bigint, keep_row bigint, group_size bigint"


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, perfect, held = None, None, None
    for batch in batches:
        kinds = batch.column("is_row").to_numpy(zero_copy_only=False)
        shards = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], ~kinds[1:] | ~kinds[:-1] | (shards[1:] != shards[:-1])])) if len(kinds) else []
        for first, last in zip(cuts, [*cuts[1:], len(kinds)]):
            part = batch.slice(first, last - first)
            if not kinds[first]:
                shard = int(shards[first])
                row = part.to_pylist()[0]
                perfect = PerfectHash(row["sizes"], row["bits"])
                held = (np.frombuffer(row["digests"], "<u8").reshape(-1, 4), pa.array(row["keep_ids"], pa.int64()),
                        pa.array(row["keep_rows"], pa.int64()), pa.array(row["group_sizes"], pa.int64()))
                continue
            keys = _words(part.column("digest"))
            if shard == shards[first]:
                slots = perfect.slots(keys)
                member = (slots >= 0) & (held[0][slots] == keys).all(axis=1)
            else:
                slots, member = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            at = pa.array(slots, mask=~member)
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), part.column("n_chars"), part.column("digest"), pa.array(member),
                 *([c.take(at) for c in held[1:]] if member.any() else [none] * 3)],
                names=["doc_id", "row", "n_chars", "digest", "member", "keep_id", "keep_row", "group_size"])


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """Digest rows with ``member`` and, for members, the winner's id and row and the size of the group in the history."""
    salts = index.table.select("shard", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts"))
    dealt = rows.withColumn("shard", shard_of(index.shards)).join(salts, "shard", "left")
    fields = [f for f in index.table.schema.fields if f.name not in ("shard", "rows")]
    salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")
    asking = dealt.select("shard", salt.alias("salt"), F.lit(True).alias("is_row"), "doc_id", "row", "n_chars", "digest",
                          *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / SALT_ROWS).cast("int") - 1))
    serving = index.table.select("shard", copies.alias("salt"), F.lit(False).alias("is_row"),
                                 *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc_id", "row", "n_chars", "digest")],
                                 *[f.name for f in fields])
    met = serving.unionByName(asking).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_row")
    return met.mapInArrow(_look_up, _FOUND)


def resolve(docs: DataFrame, history: Index | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, seen, digest, row.

    With a history, rows found there are repeats (``seen``, never kept; id and size are those of the history). All others are
    grouped among themselves, and the best row of each group is kept.
    """
    rows = digests(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept", "seen", "digest", "row"]
    repeats = None
    if history is not None:
        looked = saved(look_up(rows, history), "looked-up")
        repeats = looked.filter("member").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"),
                                                 F.lit(True).alias("seen"), "digest", "row")
        rows = looked.filter("NOT member").select("doc_id", "row", "n_chars", "digest")
    fresh = look_up(rows, build_index(rows)).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lit(False).alias("seen"), "digest", "row")
    return (fresh if repeats is None else fresh.unionByName(repeats)).select(*columns)


def keep_unique(docs: DataFrame, history: Index | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = resolve(docs, history)
    keys = saved(found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")), "decided")
    mark = unused(docs, "_digest")
    tagged = docs.withColumn(mark, digest(F.col("text")))

    def meets(rows: DataFrame, decided: DataFrame, how: str) -> DataFrame:
        # Of one form at every size: decisions grow with the documents.
        named = decided.select(F.col("doc_id").alias(mark + "i"), F.col("digest").alias(mark + "d"))
        return rows.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col(mark + "i")) & (F.col(mark) == F.col(mark + "d")), how)
    stay = meets(tagged, keys.filter("NOT kept"), "left_anti")
    # Rows alike in id and digest of which one is to stay: not in a clean table.
    twice = keys.filter("kept AND copies > 1")
    if twice.isEmpty():
        return stay.select(*docs.columns)
    single = meets(stay, twice, "left_anti")
    hashed = [F.col(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    longest = meets(stay, twice, "left_semi").groupBy("doc_id", mark).agg(
        F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), F.xxhash64(*hashed))).alias(mark + "b"))
    return single.select(*docs.columns).unionByName(longest.select(f"{mark}b.*").select(*docs.columns))
