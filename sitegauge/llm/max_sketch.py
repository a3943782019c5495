"""Ranked lexical search over hashed max-sketches.

The index holds one sketch for each document, independent of any search: a power of two of coordinates, ``RATIO`` for each distinct
term, and in each coordinate the largest count of the terms hashed there. A document's impact grows with the count, so this is
the largest impact as well. A search looks up the coordinates of its terms for whole batches of documents; the sum of the impacts found is
never below the score. Texts are then scored exactly in order of falling bounds, until no bound reaches the score of the last rank:
first the ``FIRST`` best bounds of every item, then all pairs whose bound reaches the threshold found there, in batches that grow eightfold.

The score is integer: a term weighs w = floor(1000 ln((2N+2) / (2df+1))); in a document of n terms with m = 75 + (25 n N) div L its impact is
w * ((10^9 tf) div (1000 tf + 12 m)). N, L and df count all documents and are kept with the index.

* Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z is lower-cased. NULL and empty texts hold none.
* Items with equal ids are ranked apart. Items without terms and NULL items have no rows. Items are read in blocks of at most
  ``BLOCK_TERMS`` terms (a single item may have more).
* Repeated rows take a rank each; equal scores go by ascending id, NULL last. Very long texts are counted in slices.
* Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.storage import load, save, saved
from sitegauge.operators.ranking import BROADCAST_ROWS, top_n

RATIO = 8            # coordinates for each distinct term
LEAST = 64           # coordinates of the smallest sketch
FIRST = 64           # documents of an item that are scored to find a threshold
GROWTH = 8
BLOCK_TERMS = 4096
CHUNK = 512          # documents looked up together
SLICE = 4 << 20
FLUSH = 200_000      # terms whose document counts a task holds

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that one byte stands for: exact up to 127, then four steps for each doubling, rounded up.
LEVELS = np.array([*range(128), *(math.ceil(128 * 2 ** (j / 4)) for j in range(1, 129))], np.int64)

INDEX = "doc_id bigint, digest binary, n bigint, sketch binary, term binary, df bigint"


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of every term of a text in UTF-8."""
    counts: Counter = Counter()
    folded = (text or b"").translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + SLICE)
        end = len(folded) if end < 0 else end
        counts.update(folded[start:end].split())
        start = end
    return counts


def hashes(terms: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def sketch(counts: Counter) -> np.ndarray:
    """Coordinatewise largest count, as codes of ``LEVELS``."""
    size = max(LEAST, 1 << (RATIO * len(counts) - 1).bit_length()) if counts else LEAST
    out = np.zeros(size, np.uint8)
    at = (hashes(list(counts)) & np.uint64(size - 1)).astype(np.int64)
    codes = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    np.maximum.at(out, at, codes)
    return out


def impact(tf, m):
    """Impact of one unit of weight; works for integers and arrays of them."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows equal in id and text are alike for every search."""
    text = F.col("text").cast("binary")
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce(text, F.lit(b"")))).alias("digest"), text.alias("text"))


@dataclass(frozen=True)
class Index:
    """A written index; ``documents`` is N and ``length`` is L."""
    path: str
    documents: int
    length: int


def build_index(docs: DataFrame) -> Index:
    """Sketches and document counts of all terms, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()),
                            ("term", pa.binary()), ("df", pa.int64())])
        df: Counter = Counter()

        def terms() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({**{c: pa.nulls(len(df), schema.field(c).type) for c in schema.names[:4]},
                                               "term": pa.array(df.keys(), pa.binary()), "df": pa.array(df.values(), pa.int64())}, schema)
            df.clear()
            return rows
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                sizes, sketches = [], []
                for text in part.column(2):
                    counts = term_counts(text.as_py())
                    df.update(counts.keys())
                    sizes.append(counts.total())
                    sketches.append(sketch(counts).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()),
                                                  pa.nulls(part.num_rows, pa.binary()), pa.nulls(part.num_rows, pa.int64())], schema=schema)
                if len(df) > FLUSH:
                    yield terms()
        yield terms()
    spark = docs.sparkSession
    path = save(_keyed(docs).mapInArrow(run, INDEX), "sketches")
    totals = load(spark, path).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return Index(path, totals[0], totals[1] or 0)


@dataclass(frozen=True)
class Block:
    """Items searched together: the weight of every term, and of every item the places and repeats of its terms."""
    terms: list[bytes]
    weights: list[int]
    items: list[tuple[list[int], list[int]]]

    def bounds(self, documents: int, length: int, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, bounds as items x rows) for chunks of a batch of (doc_id, digest, n, sketch)."""
        hashed = hashes(self.terms)
        places = [np.array(p, np.int64) for p, _ in self.items]
        weights = [np.array([r * self.weights[i] for i, r in zip(p, repeats)], np.int64) for p, repeats in self.items]
        column = batch.column(3)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        flat = np.frombuffer(column.buffers()[2], np.uint8)
        m = 75 + 25 * batch.column(2).to_numpy().astype(np.int64) * documents // max(1, length)
        for first in range(0, len(column), CHUNK):
            at = offsets[first:first + CHUNK + 1]
            mask = (np.diff(at) - 1).astype(np.uint64)
            codes = flat[at[:-1] + (hashed[:, None] & mask).astype(np.int64)]
            term, row = codes.nonzero()
            found = np.zeros(codes.shape, np.int64)
            found[term, row] = impact(LEVELS[codes[term, row]], m[first:first + CHUNK][row])
            yield first, np.stack([w @ found[p] for p, w in zip(places, weights)])


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Stated items with their terms, as many at a time as ``BLOCK_TERMS`` allows."""
    block: list[tuple[object, Counter]] = []
    held: set[bytes] = set()
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        counts = term_counts(bytes(row["text"]) if row["text"] is not None else None)
        if not counts:
            continue
        if block and len(held | counts.keys()) > BLOCK_TERMS:
            yield block
            block, held = [], set()
        block.append((row["item_id"], counts))
        held |= counts.keys()
    if block:
        yield block


def _weighed(index: DataFrame, documents: int, block: list[tuple[object, Counter]]) -> Block:
    terms = sorted(set().union(*(c.keys() for _, c in block)))
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in terms], "term binary")   # BLOCK_TERMS rows, or one item's
    rows = index.filter("term IS NOT NULL").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {bytes(r["term"]): r["df"] for r in rows}
    place = {t: i for i, t in enumerate(terms)}
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in terms]
    return Block(terms, weights, [([place[t] for t in c], list(c.values())) for _, c in block])


_PAIRS = "item int, doc_id bigint, digest binary, bound bigint"


def _pairs(index: DataFrame, totals: tuple[int, int], block: Block, thresholds: list[int] | None) -> DataFrame:
    """(item, doc_id, digest, bound): all that reach the thresholds, or each task's ``FIRST`` best of every item."""
    def rows(batch: pa.RecordBatch, item: np.ndarray, row: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        taken = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(bound)],
                                          names=["item", "doc_id", "digest", "bound"])

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.maximum(1, np.array(thresholds, np.int64))[:, None]
        for batch in batches:
            for first, bounds in block.bounds(*totals, batch):
                item, row = (bounds >= least).nonzero()
                yield rows(batch, item, row + first, bounds[item, row])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(block.items), np.int64)
        held: pa.Table | None = None
        for batch in batches:
            for first, bounds in block.bounds(*totals, batch):
                item, row = (bounds > floor[:, None]).nonzero()
                if not len(item):
                    continue
                new = pa.Table.from_batches([rows(batch, item, row + first, bounds[item, row])])
                held = new if held is None else pa.concat_tables([held, new])
                if len(held) > 4 * FIRST * len(block.items):
                    held = _cut(held, floor)
        if held is not None:
            yield from _cut(held, floor).combine_chunks().to_batches()
    columns = index.filter("sketch IS NOT NULL").select("doc_id", "digest", "n", "sketch")
    return columns.mapInArrow(best if thresholds is None else reaching, _PAIRS)


def _cut(held: pa.Table, floor: np.ndarray) -> pa.Table:
    """The ``FIRST`` best bounds of every item; ``floor`` rises to the last of them."""
    item, bound = held["item"].to_numpy(), held["bound"].to_numpy()
    order = np.lexsort((-bound, item))
    item = item[order]
    starts = np.searchsorted(item, np.arange(len(floor)))
    rank = np.arange(len(item)) - starts[item]
    full = rank == FIRST - 1
    floor[item[full]] = bound[order][full]
    return held.take(pa.array(order[rank < FIRST]))


def _scored(docs: DataFrame, totals: tuple[int, int], block: Block, pairs: DataFrame) -> DataFrame:
    """(item, doc_id, score, copies) of the texts of ``pairs``, rows with equal id and score counted together."""
    documents, length = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, doc_id, score = [], [], []
            for row in range(batch.num_rows):
                counts = term_counts(batch.column(1)[row].as_py())
                m = 75 + 25 * counts.total() * documents // max(1, length)
                found = [w * impact(counts[t], m) if t in counts else 0 for t, w in zip(block.terms, block.weights)]
                for i in batch.column(2)[row].as_py():
                    item.append(i)
                    doc_id.append(batch.column(0)[row].as_py())
                    score.append(sum(found[p] * r for p, r in zip(*block.items[i])))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
                                             names=["item", "doc_id", "score"])
    asked = saved(pairs.groupBy("doc_id", "digest").agg(F.collect_set("item").alias("items")), "asked")
    small = asked.count() <= BROADCAST_ROWS
    texts = _keyed(docs).alias("d")
    wanted = (F.broadcast(asked) if small else asked).alias("a")
    joined = texts.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.digest") == F.col("a.digest")))
    scores = joined.select("d.doc_id", "d.text", "a.items").mapInArrow(run, "item int, doc_id bigint, score bigint").filter("score > 0")
    return saved(scores.groupBy("item", "doc_id", "score").agg(F.count(F.lit(1)).alias("copies")), "scored")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc_id, score): copies take a rank each."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = top_n(scores, ["item"], order, top)
    each = rows.select("item", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)).cast("int"))).alias("copy"))
    return top_n(each, ["item"], [*order, F.col("copy")], top, "rank").drop("copy")


def _thresholds(scores: DataFrame, top: int, items: int) -> list[int]:
    """The score of the last rank of every item; 1 where ranks are left."""
    found = {r["item"]: r["score"] for r in _ranked(scores, top).filter(F.col("rank") == top).collect()}   # a row for each item
    return [found.get(i, 1) for i in range(items)]


def _search_block(docs: DataFrame, index: Index, block: Block, top: int) -> DataFrame:
    spark = docs.sparkSession
    sketches = load(spark, index.path)
    totals = (index.documents, index.length)
    size = len(block.items)
    first = top_n(_pairs(sketches, totals, block, None), ["item"], [F.col("bound").desc(), F.col("doc_id"), F.col("digest")], max(FIRST, top))
    least = _thresholds(_scored(docs, totals, block, first), top, size)
    left = saved(_pairs(sketches, totals, block, least).distinct(), "open")
    scores, batch = None, FIRST * GROWTH
    while True:
        counts = {r["item"]: r["count"] for r in left.groupBy("item").count().collect()}
        if not counts:
            break
        more = max(counts.values()) > batch
        cuts = _at_least(left, counts, batch, size) if more else [0] * size
        taken = left.join(_by_item(spark, cuts), "item").filter("bound >= least") if more else left
        new = _scored(docs, totals, block, taken)
        scores = new if scores is None else scores.unionByName(new)
        if not more:
            break
        least = [max(a, b) for a, b in zip(least, _thresholds(scores, top, size))]
        rest = left.join(_by_item(spark, cuts), "item").filter("bound < least").drop("least")
        left = saved(rest.join(_by_item(spark, least), "item").filter("bound >= least").drop("least"), "open")
        batch *= GROWTH
    if scores is None:
        return spark.createDataFrame([], "item int, doc_id bigint, score bigint, rank int")
    return _ranked(scores, top)


def _at_least(left: DataFrame, counts: dict[int, int], batch: int, size: int) -> list[int]:
    """A bound for every item that about ``batch`` of its open pairs reach; any bound gives right results."""
    share = _by_item(left.sparkSession, [batch if counts.get(i, 0) > batch else 0 for i in range(size)])
    near = F.percentile_approx("bound", F.array(*[F.lit(1 - 0.5 ** j) for j in range(1, 21)]), 1000).alias("cuts")
    rows = left.join(share, "item").groupBy("item", "least").agg(near, F.count(F.lit(1)).alias("n")).collect()
    # Halves of the order: the j-th cut leaves n / 2^j pairs above it.
    return [next((r["cuts"][min(19, max(0, math.floor(math.log2(r["n"] / r["least"])) - 1))] for r in rows if r["item"] == i and r["least"]), 0)
            for i in range(size)]


def _by_item(spark, values: list[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), "item int, least bigint"))   # a row for each item of a block


def search(docs: DataFrame, index: Index, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best rows of ``docs``, which the index was built of, for every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    found = None
    for block in _blocks(items):
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
        ranked = _search_block(docs, index, _weighed(load(spark, index.path), index.documents, block), top)
        rows = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        rows = saved(rows, "ranked")
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
