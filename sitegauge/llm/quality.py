"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes, cut into blocks of ``BLOCK``; two neighbouring blocks make a chunk, so chunks overlap by half and
cover the whole text, whatever its length. ``FILTERS`` learned filters of ``REACH`` bytes slide over every byte; each chunk
keeps the maximum of every filter. A text's features are the maximum and the mean over its chunks, as one odd chunk should not speak for a
long text alone; a logistic unit combines them into one probability. The gradient of a maximum flows to one place only, which makes training cheap.

Training sees at most ``SAMPLE`` labelled texts per class, drawn by hash, each as a whole, and never a document that is
held out (crc32 of its id divisible by 5). The class shares of all labelled rows correct the balanced sample. Language,
source and id are no inputs. Scoring reads whole texts.

* NULL and empty texts are one block of zero bytes and get that block's score. Labels that are NULL are ignored; several labels of
  a document are averaged. With labels of one class only, or none, every score is the share of the class (0.5 for none).
* Rows without an id are never held out. Repeated rows are scored alike. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
REACH = 6
FILTERS = 16
SAMPLE = 1500
PAD = REACH
STEPS = 600
BATCH = 64
RATE = 0.05  # of Adam
ACCEPT = 0.3
SLICE = 256  # blocks at a time, so that responses stay in the cache


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded bytes of all texts, each in blocks of its own after ``PAD`` zeros, and the first block of every text."""
    counts = np.array([(len(t) + PAD) // BLOCK + 1 for t in texts], np.int64)
    first = np.cumsum(counts) - counts
    data = np.zeros(int(counts.sum()) * BLOCK + PAD, np.uint8)
    for start, text in zip((first * BLOCK + PAD).tolist(), texts):
        data[start:start + len(text)] = np.frombuffer(text, np.uint8)
    return data, first


@dataclass
class Network:
    """``taps`` (REACH, 256, FILTERS), ``bias``, ``top`` and ``mean`` (FILTERS each) and ``offset``."""
    taps: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    mean: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        taps = rng.normal(0, 0.3, (REACH, 256, FILTERS)).astype(np.float32)
        taps[:, 0] = 0
        signs = np.where(np.arange(FILTERS) % 2, 1, -1).astype(np.float32)
        return cls(taps, np.zeros(FILTERS, np.float32), signs * 0.1, signs * 0.1, 0.0)

    def pairs(self) -> list[np.ndarray]:
        """Taps of two neighbouring bytes summed, so that a window needs half the look-ups."""
        return [(self.taps[j][None, :] + self.taps[j + 1][:, None]).reshape(65536, FILTERS) for j in range(0, REACH, 2)]

    def responses(self, data: np.ndarray, pairs: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response per block and filter and, if asked for, its position in the block."""
        blocks = (len(data) - PAD) // BLOCK
        best = np.empty((blocks, FILTERS), np.float32)
        place = np.zeros((blocks, FILTERS) if where else (0, 0), np.int64)
        wide = data.astype(np.int32)
        two = wide[:-1] | wide[1:] << 8
        for low in range(0, blocks, SLICE):
            high = min(blocks, low + SLICE)
            n = (high - low) * BLOCK
            at = low * BLOCK
            total = pairs[0].take(two[at:at + n], axis=0)
            for j, pair in enumerate(pairs[1:], 1):
                total += pair.take(two[at + 2 * j:at + 2 * j + n], axis=0)
            cube = total.reshape(high - low, BLOCK, FILTERS)
            cube.max(axis=1, out=best[low:high])
            if where:
                place[low:high] = cube.argmax(axis=1)
        return best, place

    def features(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk features, and per text their maximum and mean."""
        ends = np.append(first[1:], len(best))
        follow = np.minimum(np.arange(1, len(best) + 1), np.repeat(ends, ends - first) - 1)
        chunks = np.maximum(np.maximum(best, best[follow]) + self.bias, 0)
        return chunks, np.maximum.reduceat(chunks, first, axis=0), np.add.reduceat(chunks, first, axis=0) / (ends - first)[:, None]

    def logits(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return most @ self.top + mean @ self.mean + self.offset

    def scores(self, texts: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
        data, first = blocks_of(texts)
        best, _ = self.responses(data, pairs)
        _, most, mean = self.features(best, first)
        return 1 / (1 + np.exp(-self.logits(most, mean).astype(np.float64)))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, first = blocks_of(texts)
    best, place = net.responses(data, net.pairs(), where=True)
    chunks, most, mean = net.features(best, first)
    error = (1 / (1 + np.exp(-net.logits(most, mean))) - labels).astype(np.float32) / len(labels)
    ends = np.append(first[1:], len(best))
    text_of = np.repeat(np.arange(len(first)), ends - first)
    # Of equal maxima, the first chunk of a text gets the gradient.
    hit = chunks == most[text_of]
    counted = np.cumsum(hit, axis=0)
    before = np.vstack([np.zeros((1, FILTERS), counted.dtype), counted])[first]
    leader = hit & (counted - before[text_of] == 1)
    back = np.where(leader, (error[:, None] * net.top)[text_of], 0) + (error / (ends - first))[text_of, None] * net.mean
    back = np.where(chunks > 0, back, 0)
    follow = np.minimum(np.arange(1, len(best) + 1), ends[text_of] - 1)
    source = np.where(best >= best[follow], np.arange(len(best))[:, None], follow[:, None])
    columns = np.broadcast_to(np.arange(FILTERS), source.shape)
    at = (source * BLOCK + place[source, columns]).ravel()
    taps = np.zeros_like(net.taps)
    for j in range(REACH):
        cell = data[at + j].astype(np.int64) * FILTERS + columns.ravel()
        taps[j] = np.bincount(cell, back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    taps[:, 0] = 0
    return [taps, back.sum(axis=0), error @ most, error @ mean, np.asarray(error.sum())]


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 0) -> Network:
    """Fit on the sample; ``share`` is the share of label 1 among all labelled rows."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    values = [net.taps, net.bias, net.top, net.mean, np.zeros(())]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    for step in range(1, STEPS + 1):
        part = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        for i, g in enumerate(_gradients(net, [texts[k] for k in part], labels[part])):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            rate = RATE * min(1.0, 2 * (STEPS - step) / STEPS) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-6)
            values[i] = (values[i] - rate * first[i] / (1 - 0.9 ** step)).astype(np.float32)
        net = Network(*values[:4], float(values[4]))
    drawn = 0.5
    net.offset += float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """The network, or a constant score where the labels hold fewer than two classes."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    total = sum(counts.values())
    share = counts.get(True, 0) / total if total else 0.5
    if len(counts) < 2:
        return share
    draw = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = [known.filter(F.col("good") == good).select("doc_id", "good").orderBy(draw, "doc_id").limit(sample) for good in (True, False)]
    # At most 2 * sample short rows.
    drawn = docs.filter("text IS NOT NULL").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = drawn.groupBy("doc_id", "good").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    good = np.array([r["good"] for r in rows], np.float32)
    if len(set(good.tolist())) < 2:
        return share
    return train([r["text"].encode("utf-8", "surrogatepass") for r in rows], good, share)


def score(docs: DataFrame, model: Network | float, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` with the score of the whole text as column ``name``."""
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = None if isinstance(model, float) else model.pairs()
        for batch in batches:
            if pairs is None:
                scores = np.full(batch.num_rows, float(model))
            else:
                texts, held, parts = [], 0, []
                for value in batch.column(batch.num_columns - 1):
                    texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
                    held += len(texts[-1])
                    if held > 1 << 18:
                        parts.append(model.scores(texts, pairs))
                        texts, held = [], 0
                if texts:
                    parts.append(model.scores(texts, pairs))
                scores = np.concatenate(parts) if parts else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[f.name for f in schema.fields])
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(run, schema)
