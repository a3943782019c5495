"""Bounded-space online packing of documents into fixed-length token sequences.

Every partition of the input keeps at most ``open_windows`` windows. The whole windows of a long document are cut off
first; its rest goes where it fits best. When it fits nowhere and all windows are open, the head of the rest fills
up the fullest window, which is emitted, and the tail is placed anew. At the end of a partition the windows still
open are merged (emptiest into fullest), which leaves one; these are merged over the partitions, ``fan_in`` at a time,
until one is left. The last one is cut at powers of two, which need no padding.

Layout, and thus every id, depends only on the order of rows within input partitions. The pieces are written to the shared
folder once, so a lost executor cannot mix two layouts.

* NULL text counts as empty; each document ends with the end id, so it has one token at least.
* NULL or repeated document ids: rows are packed one by one, ids are only carried.
* An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.storage import load, save, saved
from sitegauge.llm.tokens import encoder, public_vocabulary

WIDTH = 2048
OPEN_WINDOWS = 32
FAN_IN = 64

PIECE = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, "
         "sequence_id bigint, offset bigint, rest bigint")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("rest", pa.int64())])

Piece = tuple[int | None, int, np.ndarray, int]  # document, start in it, ids, tokens of the document


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


class Packer:
    """Open windows of one partition, sorted by free space."""

    def __init__(self, width: int = WIDTH, open_windows: int = OPEN_WINDOWS):
        self.width, self.limit = width, open_windows
        self.free: list[int] = []
        self.windows: list[list[Piece]] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place one document; yields the windows that are complete."""
        while len(piece[2]) >= self.width:
            head, piece = _cut(piece, self.width)
            yield [head]
        while len(piece[2]):
            need = len(piece[2])
            best = bisect_left(self.free, need)
            if best < len(self.free):
                free, window = self.free.pop(best), self.windows.pop(best)
            elif len(self.free) < self.limit:
                free, window = self.width, []
            else:
                free, window = self.free.pop(0), self.windows.pop(0)
            head, piece = _cut(piece, min(free, need))
            window.append(head)
            free -= len(head[2])
            if free:
                at = bisect_left(self.free, free)
                self.free.insert(at, free)
                self.windows.insert(at, window)
            else:
                yield window

    def leftovers(self) -> list[list[Piece]]:
        return self.windows


def _size(window: list[Piece]) -> int:
    return sum(len(p[2]) for p in window)


def _take(pieces: deque[Piece], n: int) -> list[Piece]:
    """Move ``n`` ids, or all there are, from the front of ``pieces``."""
    taken = []
    while n and pieces:
        head, tail = _cut(pieces.popleft(), n)
        taken.append(head)
        n -= len(head[2])
        if len(tail[2]):
            pieces.appendleft(tail)
    return taken


def merge(windows: list[list[Piece]], width: int = WIDTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill the fullest windows from the emptiest. Returns the full ones and what is left (less than a window)."""
    held, full, supply = deque(sorted(windows, key=_size)), [], deque()
    while held or supply:
        window = list(held.pop()) if held else _take(supply, width)
        need = width - _size(window)
        while need and (supply or held):
            supply = supply or deque(held.popleft())
            more = _take(supply, need)
            window += more
            need -= _size(more)
        if need:
            return full, window
        full.append(window)
    return full, []


def powers(window: list[Piece]) -> list[list[Piece]]:
    """Cut a window into sequences whose lengths are powers of two."""
    pieces, left, out = deque(window), _size(window), []
    while left:
        out.append(_take(pieces, 1 << (left.bit_length() - 1)))
        left -= _size(out[-1])
    return out


class _Rows:
    """Collects piece rows and hands them over in batches of bounded size."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.clear()

    def clear(self) -> None:
        self.columns: tuple[list, ...] = tuple([] for _ in _ARROW)
        self.bytes = 0

    def add(self, window: list[Piece], rest: int | None = None) -> None:
        at = 0
        for doc, start, ids, total in window:
            data = ids.astype("<u4").tobytes()
            for column, value in zip(self.columns, (doc, start, len(ids), total, data, self.sequence, at, rest)):
                column.append(value)
            at += len(ids)
            self.bytes += len(data)
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, _ARROW)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _pack_partition(vocabulary: str | None, width: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary or public_vocabulary())
        partition = TaskContext.get().partitionId()
        packer, rows = Packer(width, open_windows), _Rows(partition << 32)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, ids, ends in words.documents(batch.column(1)):
                begin = 0
                for doc, end in zip(docs[first:], ends.tolist()):
                    for window in packer.add((doc, 0, ids[begin:end].copy(), end - begin)):
                        rows.add(window)
                    begin = end
                    if rows.bytes > 4 << 20:
                        yield rows.batch()
        full, rest = merge(packer.leftovers(), width)
        for window in full:
            rows.add(window)
        if rest:
            rows.add(rest, partition)
        yield rows.batch()
    return run


def _merge_group(width: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        windows: dict[int, list[Piece]] = {}
        for r in table.sort_by([("rest", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.setdefault(r["rest"], []).append(
                (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        rows = _Rows(1 << 62 | level << 56 | group << 32)
        full, rest = merge(list(windows.values()), width)
        for window in full + (powers(rest) if last else []):
            rows.add(window)
        if rest and not last:
            rows.add(rest, group)
        return pa.Table.from_batches([rows.batch()])
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, open_windows: int = OPEN_WINDOWS,
         fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (document, start, length, ids as little-endian 32-bit integers) with their sequence and offset."""
    spark = docs.sparkSession
    placed = load(spark, save(
        docs.select("doc_id", "text").mapInArrow(_pack_partition(vocabulary, width, open_windows), PIECE), "packed"))
    done = placed.filter("rest IS NULL")
    rest, level = placed.filter("rest IS NOT NULL"), 1
    count = (rest.agg(F.max("rest")).first()[0] or 0) + 1
    while True:
        last = count <= fan_in
        keyed = rest.withColumn("bundle", F.expr(f"rest div {fan_in}"))
        merged = saved(keyed.groupBy("bundle").applyInArrow(_merge_group(width, level, last), PIECE), "merged")
        done = done.unionByName(merged.filter("rest IS NULL"))
        if last:
            return done.drop("rest")
        rest, level, count = merged.filter("rest IS NOT NULL"), level + 1, -(-count // fan_in)
