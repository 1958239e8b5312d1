"""Token ids in patched frame-of-reference blocks.

A segment is one self-contained binary value: a header, the table of its documents, the index of its blocks and the
packed blocks. A block holds 128 ids: its minimum is subtracted, the differences are packed at the width that the
chosen percentile of them needs, and the rest go to an exception list as (position, whole difference). The index has
each block's minimum, width, and where its words and exceptions start, so one block can be read alone.

Segments are rows of a table that Spark writes (one file or more per shard, committed per task, on any file system
Spark can write to); shards follow ascending doc_id. Layout of a segment, all little-endian:

    magic "PFB1", u32 values, u32 documents, u32 blocks, u32 words, u32 exceptions
    i64 doc_id[documents], u8 doc_id_is_null[documents], u32 tokens[documents]
    u32 minimum[blocks], u8 width[blocks], u32 first word[blocks], u32 first exception[blocks]
    u32 words[words], u8 exception position[exceptions], u32 exception difference[exceptions]
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import BROADCAST_STARTS, prepare, range_shards, shard_partitions, written

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4s5I")
SEGMENT_SCHEMA = "shard long, segment int, shard_start long, n_docs int, n_tokens long, data binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 32) values of up to width bits -> (m, width) words."""
    v, out = np.ascontiguousarray(values.T), np.zeros((width, len(values)), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[word] |= v[j] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= v[j] >> np.uint32(32 - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(m, width) words -> (m, 32) values."""
    w, mask = np.ascontiguousarray(words.T), np.uint32((1 << width) - 1)
    out = np.empty((32, len(words)), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        x = w[word] >> np.uint32(shift)
        if shift + width > 32:
            x |= w[word + 1] << np.uint32(32 - shift)
        out[j] = x & mask
    return out.T


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = ids
    v[n:] = ids[-1] if n else 0
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    block, position = np.nonzero(bits > width[:, None])
    first_exception = np.searchsorted(block, np.arange(blocks)).astype(np.uint32)
    sizes = width.astype(np.int64) * (BLOCK // 32)
    first_word = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(int(first_word[-1]), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            kept = v[rows] & np.uint32((1 << int(w)) - 1)
            packed = _pack(kept.reshape(-1, 32), int(w)).reshape(len(rows), -1)
            words[first_word[rows][:, None] + np.arange(packed.shape[1])] = packed
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((
        _HEAD.pack(b"PFB1", n, len(doc_ids), blocks, len(words), len(block)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.asarray(counts, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), first_word[:-1].astype("<u4").tobytes(), first_exception.astype("<u4").tobytes(),
        words.astype("<u4").tobytes(), position.astype(np.uint8).tobytes(), v[block, position].astype("<u4").tobytes(),
    ))


class Segment:
    """Reads one segment, whole or by block."""

    def __init__(self, data: bytes):
        magic, self.n, docs, blocks, words, exceptions = _HEAD.unpack_from(data)
        if magic != b"PFB1":
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.counts = take("<u4", docs)
        self.low, self.width = take("<u4", blocks), take("u1", blocks)
        self.first_word, self.first_exception = take("<u4", blocks), take("<u4", blocks)
        self.words, self.position, self.value = take("<u4", words), take("u1", exceptions), take("<u4", exceptions)

    def _ends(self) -> np.ndarray:
        return np.append(self.first_exception[1:], len(self.position)).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        """The ids of one block, from the index alone."""
        w, at = int(self.width[i]), int(self.first_word[i])
        out = _unpack(self.words[at : at + w * BLOCK // 32].reshape(-1, w), w).reshape(-1) if w else np.zeros(BLOCK, np.uint32)
        a, b = int(self.first_exception[i]), int(self._ends()[i])
        out[self.position[a:b]] = self.value[a:b]
        return (out + self.low[i])[: min(BLOCK, self.n - i * BLOCK)]

    def ids(self) -> np.ndarray:
        out = np.zeros((len(self.low), BLOCK), np.uint32)
        for w in np.unique(self.width):
            if w:
                rows = np.nonzero(self.width == w)[0]
                at = self.first_word[rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 32)
                out[rows] = _unpack(self.words[at].reshape(-1, int(w)), int(w)).reshape(-1, BLOCK)
        block = np.repeat(np.arange(len(self.low)), self._ends() - self.first_exception)
        out[block, self.position] = self.value
        return (out + self.low[:, None]).reshape(-1)[: self.n]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write all ids in ascending doc_id order as segments under path.

    Null text: no ids but the end id. Null doc_ids come first; repeated doc_ids stay, ordered by their ids. An empty
    table writes no segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows, shards, _ = range_shards(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    width = bpe.id_type(tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
        at, number, before, held, size = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held, size
            counts = np.array([len(x) // width.itemsize for _, x in held])
            data = encode_segment([k for k, _ in held], counts, np.frombuffer(b"".join(x for _, x in held), width))
            total = int(counts.sum())
            row = [[at], [number], [before], [len(held)], [total], [data]]
            number, before, held, size = number + 1, before + total, [], 0
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for s, k, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (s != at or size >= SEGMENT_IDS):
                    yield flush()
                if s != at:
                    at, number, before = s, 0, 0
                held.append((k, x))
                size += len(x) // width.itemsize
        if held:
            yield flush()

    ids = bpe.encoded(rows, tokenizer_path, end_id, "k", "t", "_shard").select(F.col("_shard").alias("shard"), "k", "ids")
    dealt = ids.repartition(shard_partitions(shards), "shard").sortWithinPartitions("shard", "k", "ids")
    dealt.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian u32 binary, start the count of ids of all documents before."""
    prepare(spark)
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard, which one task can add up
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sums.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shard-bases")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                segment = Segment(data)
                ids = segment.ids().astype("<u4").tobytes()
                counts = segment.counts.astype(np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.doc_ids, pa.int64()), pa.array(starts + base), pa.array(counts), pa.array([ids[4 * i : 4 * j] for i, j in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = table.select("shard", "shard_start", "data").join(starts, "shard").select((F.col("base") + F.col("shard_start")).alias("base"), "data")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
