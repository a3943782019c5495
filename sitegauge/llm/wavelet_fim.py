"""Fill-in-the-middle transformation with a wavelet matrix over character classes.

The bytes of a text fall into four classes: line feeds, bytes that continue a character, first characters of words, all others. A wavelet
matrix answers how many of a class stand before a position (rank). Sums of ranks count the units that end or begin there, so that
bisection on them finds the byte behind the k-th unit, and the byte less the continuing ones is a position in code points. Both cuts of
a document are drawn from a hash of its id, so a rerun cuts alike.

* Units: ``line`` (with its line feed), ``word`` (with the white space after it; the first one takes leading white space), ``char``.
* NULL counts as an empty text. Empty texts and texts that hold a mark stay plain. NULL ids are drawn like an empty id.
* Repeated rows are cut alike and stay. Extra columns are ignored. Empty tables give empty results. A text of any length costs a
  quarter of its bytes for the matrix, and its classes while it is built.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_FEED, CONTINUES, WORD, OTHER = range(4)
BLOCK = 256   # bits between counts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[10] = LINE_FEED
_CLASS[0x80:0xC0] = CONTINUES
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def classes(text: bytes) -> np.ndarray:
    """The class of every byte."""
    raw = np.frombuffer(text, np.uint8)
    found = _CLASS[raw]
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    found[begins] = WORD
    return found


class Bits:
    """A bit vector with the number of ones before every block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(packed)
        self.packed = packed.tobytes()
        starts = np.arange(0, len(ones), BLOCK // 8)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, starts, dtype=np.int64))]).tolist() if len(ones) else [0]

    def rank(self, end: int) -> int:
        """Ones among the first ``end`` bits."""
        block, rest = divmod(end, BLOCK)
        if not rest:
            return self.before[block]
        held = self.packed[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)]
        return self.before[block] + (int.from_bytes(held, "little") & ((1 << rest) - 1)).bit_count()


class WaveletMatrix:
    """Symbols of ``depth`` bits; every level keeps one bit of each and sorts stably by it for the next."""

    def __init__(self, symbols: np.ndarray, depth: int = 2):
        self.size, self.levels = len(symbols), []
        for bit in reversed(range(depth)):
            ones = (symbols >> bit & 1).astype(bool)
            bits = Bits(ones)
            self.levels.append((bit, bits, self.size - bits.rank(self.size)))
            if bit:
                symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = [self._at(symbol, 0) for symbol in range(1 << depth)]

    def _at(self, symbol: int, end: int) -> int:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(end)
            end = zeros + ones if symbol >> bit & 1 else end - ones
        return end

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of ``symbol`` among the first ``end``."""
        return self._at(symbol, end) - self.first[symbol]


class Cutter:
    """Counts the units of one text and finds the byte behind any of them."""

    def __init__(self, text: bytes, unit: str = "line"):
        if unit not in ("line", "word", "char"):
            raise ValueError(f"unknown unit {unit}")
        self.unit, self.matrix = unit, WaveletMatrix(classes(text))
        # A last line may lack its line feed; white space alone is one unit.
        size, ended = len(text), text.endswith(b"\n")
        if unit == "line":
            self.units = self.marks(size) + (size > 0 and not ended)
        else:
            self.units = max(self.marks(size), int(size > 0))

    def marks(self, end: int) -> int:
        """Units that end (lines) or begin (others) among the first ``end`` bytes."""
        rank = self.matrix.rank
        if self.unit == "line":
            return rank(LINE_FEED, end)
        if self.unit == "word":
            return rank(WORD, end)
        return rank(LINE_FEED, end) + rank(WORD, end) + rank(OTHER, end)

    def behind(self, units: int) -> int:
        """Bytes of the first ``units`` units."""
        if units == 0 or units >= self.units:
            return self.matrix.size if units else 0
        if self.unit == "line":
            return bisect_left(range(self.matrix.size + 1), units, key=self.marks)
        return bisect_left(range(self.matrix.size + 1), units + 1, key=self.marks) - 1

    def chars(self, end: int) -> int:
        """Code points of the first ``end`` bytes."""
        return end - self.matrix.rank(CONTINUES, end)


@dataclass(frozen=True)
class Settings:
    """``rate`` and ``spm_rate`` are percent: of documents that are cut, and of those with the suffix first."""
    unit: str = "line"
    seed: str = "7"
    rate: int = 100
    spm_rate: int = 50


def transform_text(doc_id: int | None, text: bytes, settings: Settings = Settings()) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of one text."""
    drawn = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[k:k + 8], 16) for k in (0, 8, 16, 24)]
    cutter = Cutter(text, settings.unit)
    n = cutter.units
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= settings.rate:
        return n, "plain", None, None, text
    a, b = (cutter.behind(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    form, output = ("spm", s + suffix + p + prefix + m + middle) if h[3] % 100 < settings.spm_rate else ("psm", p + prefix + s + suffix + m + middle)
    return n, form, cutter.chars(a), cutter.chars(b) - cutter.chars(a), output


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                rows = [transform_text(i.as_py(), t.as_py() or b"", settings) for i, t in zip(part.column(0), part.column(1))]
                *head, output = (pa.array(c, k) for c, k in zip(zip(*rows), kinds))
                yield pa.RecordBatch.from_arrays([part.column(0), *head, output.cast(pa.string())],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The parts hold no mark, so the first of each kind is the one that was put there."""
    def between(after: str, before: str) -> Column:
        start = F.instr(output, after) + len(after)
        return F.substring(output, start, F.instr(output, before) - start)

    def behind(after: str) -> Column:
        return F.substring(output, F.instr(output, after) + len(after), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), behind(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), behind(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
