"""Token ids on disk: one zstandard frame per document, all frames sharing one trained dictionary.

A data set is a folder of three tables, written by Spark so that any store it can write to will do:

* ``blocks``: one row per block of neighbouring documents: ``shard``, ``block``, ``start`` (ids before it in the shard), ``doc_ids``,
  ``counts`` (ids per document), ``offsets`` (byte offsets of the frames, one more than documents), ``data`` (the
  frames), ``lowest`` and ``highest`` document id, ``dictionary`` (SHA-256 of the dictionary).
* ``shards``: ``shard``, ``base`` (ids in all shards before it).
* ``dictionary``: its SHA-256, its bytes (empty: none), the width of an id in bytes.

Documents are in ascending id order over shards and blocks, NULL first; rows with the same id are ordered by their ids. A frame
can be read alone: the offsets lead to it, the dictionary's hash says how to decompress it.

* The dictionary is trained on at most ``SAMPLES`` documents of at most ``SAMPLE_BYTES`` bytes, drawn by hash. It
  affects the size only. Tables too small to train one are written without.
* NULL text counts as empty (one id, the end id). An empty table gives an empty data set. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.llm.storage import load, save
from sitegauge.llm.tokens import encoder, public_vocabulary

SAMPLES = 512
SAMPLE_BYTES = 8 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20

_IDS = "doc_id bigint, n_tokens bigint, ids binary"
_BLOCK = ("shard int, block int, start bigint, doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, "
          "data binary, lowest bigint, highest bigint, dictionary string")


def id_width(vocabulary: str | None = None) -> int:
    """Bytes that hold every id of the vocabulary: 2 or 4."""
    return 2 if encoder(vocabulary or public_vocabulary()).tokenizer.get_vocab_size() <= 1 << 16 else 4


def serialise(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each document's ids, end id included, as little-endian integers of ``id_width`` bytes."""
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary or public_vocabulary())
        for batch in batches:
            docs = batch.column(0)
            for first, ids, ends in words.documents(batch.column(1)):
                offsets = np.concatenate([[0], ends])
                binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [
                    None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(first, len(ends)), pa.array(np.diff(offsets)), binary.cast(pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, _IDS)


def train(ids: DataFrame) -> bytes:
    """Dictionary from a bounded sample: the ``SAMPLES`` short documents with the smallest hashes."""
    short = ids.filter(F.octet_length("ids") <= SAMPLE_BYTES).withColumn("draw", F.xxhash64("doc_id", "ids"))
    drawn = [r[0] for r in short.select("draw").orderBy("draw").limit(SAMPLES).collect()]
    if not drawn:
        return b""
    sample = [bytes(r[0]) for r in short.filter(F.col("draw") <= drawn[-1]).select("ids").limit(SAMPLES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compress(dictionary: bytes):
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            row = {"shard": shard, "block": block, "start": start, "doc_ids": docs, "counts": counts,
                   "offsets": np.cumsum([0, *map(len, frames)]).tolist(), "data": b"".join(frames),
                   "lowest": min(known, default=None), "highest": max(known, default=None), "dictionary": name}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                frame = compressor.compress(ids)
                docs.append(doc)
                counts.append(n)
                frames.append(frame)
                held += len(frame) + 16
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, start, held, docs, counts, frames = block + 1, start + sum(counts), 0, [], [], []
        if docs:
            yield flush()
    return run


_BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary()),
    ("lowest", pa.int64()), ("highest", pa.int64()), ("dictionary", pa.string())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the data set below ``path``."""
    spark = docs.sparkSession
    ids = load(spark, save(serialise(docs, vocabulary), "ids"))
    dictionary = train(ids)
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), id_width(vocabulary))],
        "dictionary string, bytes binary, width int").write.parquet(f"{path}/dictionary")
    # Frames are compressed already; the ids travel in Spark's own compressed shuffle.
    (ids.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
        .mapInArrow(_compress(dictionary), _BLOCK)
        .write.option("compression", "none").parquet(f"{path}/blocks"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))
    # One row per shard, that is per task of the writing job.
    (load(spark, f"{path}/blocks").groupBy("shard").agg(held.alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards"))


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, int]:
    kept = load(spark, f"{path}/dictionary").first()
    if hashlib.sha256(kept["bytes"]).hexdigest() != kept["dictionary"]:
        raise ValueError("the dictionary does not match its hash")
    # The shards join the blocks while these are still compressed.
    return load(spark, f"{path}/blocks").join(load(spark, f"{path}/shards"), "shard"), bytes(kept["bytes"]), kept["width"]


def _decompress(dictionary: bytes, width: int, wanted: frozenset[int] | None = None):
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if row["dictionary"].as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                data, offsets = row["data"].as_buffer(), row["offsets"].values.to_numpy()
                counts = row["counts"].values.to_numpy()
                starts = row["base"].as_py() + row["start"].as_py() + np.cumsum(counts) - counts
                docs = row["doc_ids"].as_py()
                take = range(len(docs)) if wanted is None else [k for k, d in enumerate(docs) if d in wanted]
                for part in (take[k:k + 256] for k in range(0, len(take), 256)):
                    frames = (expand.decompress(data[int(offsets[k]):int(offsets[k + 1])]) for k in part)
                    ids = [f if width == 4 else np.frombuffer(f, "<u2").astype("<u4").tobytes() for f in frames]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([docs[k] for k in part], pa.int64()), pa.array(starts[list(part)]), pa.array(counts[list(part)]),
                         pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
    return run


_DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (little-endian 32-bit)."""
    blocks, dictionary, width = _opened(spark, path)
    return blocks.mapInArrow(_decompress(dictionary, width), _DOCUMENT)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of single documents: only blocks that may hold them are read, only their frames decompressed."""
    blocks, dictionary, width = _opened(spark, path)
    near = F.lit(False)
    for doc in doc_ids:
        near = near | ((F.col("lowest") <= doc) & (F.col("highest") >= doc))
    found = blocks.filter(near).mapInArrow(_decompress(dictionary, width, frozenset(doc_ids)), _DOCUMENT)
    return found
