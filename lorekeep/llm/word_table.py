"""BPE encoding through a distinct-word table, and decoding through an id-to-piece join.

For tokenizers whose white space separates words and yields no token:

1. Each task splits its documents into words and numbers the distinct words of a block of documents (a block ends when
   it has BLOCK_WORDS distinct words or BLOCK_BYTES of text). A block's documents become lists of word numbers.
2. The distinct words of all blocks are dealt by word hash to buckets. A bucket encodes each of its distinct words once,
   however many blocks ask for it, and answers each block with the ids of its words, in the order asked.
3. The answers meet their block, and each position of a document takes the ids of the word number that stands there.

A word crosses the network once per block and not once per occurrence, so a very frequent word weighs no more than a
rare one, and words of a block and bucket travel as one compressed list. No table of words is ever broadcast.

Decoding joins ids with the id-to-piece table in each task: the table has as many rows as the vocabulary, a fixed bound.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import prepare, shuffle_partitions, written

BLOCK_WORDS = 1 << 19
BLOCK_BYTES = 48 << 20
#: Texts of about so many bytes share a bucket of distinct words, in each of which one task encodes.
BUCKET_BYTES = 128 << 20
SPLITS = "spark.sql.files.minPartitionNum"
_PIECES: dict[str, pa.Array] = {}


class _Numbers(dict):
    """word -> position in its bucket * buckets + bucket; lists has the words by bucket, in that order."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.lists = buckets, [[] for _ in range(buckets)]

    def __missing__(self, word):
        k = zlib.crc32(word) % self.buckets
        self[word] = n = len(self.lists[k]) * self.buckets + k
        self.lists[k].append(word)
        return n


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _lists(data: bytes) -> list[bytes]:
    """Length-prefixed byte strings."""
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    body = data[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _joined(parts: list[bytes]) -> bytes:
    return b"".join((len(parts).to_bytes(4, "little"), np.fromiter(map(len, parts), "<u4", len(parts)).tobytes(), *parts))


def _is_scan(df: DataFrame) -> bool:
    """Whether two reads give the same rows in the same order and tasks: files, with columns or rows left out."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return set(nodes) <= {"Project", "Filter", "Relation", "LocalRelation"}


def _blocks(rows: DataFrame, what: str, buckets: int, block_words: int, block_bytes: int) -> DataFrame:
    """The documents or the word lists of each block; both passes number words alike, as a task's rows come in one order.

    A block's lists and the last of its documents have a checksum of its texts, so that passes that were cut differently
    end in an error and never in wrong ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, words, kept, check = TaskContext.get().partitionId() << 24, 0, _Numbers(buckets), [], 0

        def documents(end: bool) -> pa.RecordBatch:
            keys = pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64())], names=["k"])
            data = _squeeze(_joined([keys.serialize().to_pybytes(), *(x for _, x in kept)]))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data], pa.binary()), pa.array([check if end else None], pa.int64())], names=["block", "data", "text_sum"])

        def lists() -> Iterator[pa.RecordBatch]:
            for k, found in enumerate(words.lists):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([k], pa.int32()), pa.array([_squeeze(_joined(found))], pa.binary()), pa.array([check])], names=["block", "bucket", "words", "text_sum"])

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                numbers = np.array(list(map(words.__getitem__, (text or b"").split())), "<u4")
                size, check = size + len(text or b""), zlib.crc32(text or b"", check)
                if what == "documents":
                    kept.append((k, numbers.tobytes()))
                    if len(kept) >= 1024:
                        yield documents(False)
                if len(words) >= block_words or size >= block_bytes:
                    if what == "words":
                        yield from lists()
                    else:
                        yield documents(True)
                    block, size, words, check = block + 1, 0, _Numbers(buckets), 0
        if what == "words":
            yield from lists()
        elif size or kept:
            yield documents(True)

    return rows.mapInArrow(run, "block long, data binary, text_sum long" if what == "documents" else "block long, bucket int, words binary, text_sum long")


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ids array<int>) for every row, equal to the library's ids of the whole text without added special tokens.

    Null and empty texts have no ids; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    if bpe.encoder(tokenizer_path).kind != "drop":
        raise ValueError("this tokenizer's words depend on the white space between them")
    dtype = bpe.id_type(tokenizer_path)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    if not _is_scan(docs):
        rows = written(rows, "documents")
    if spark.conf.get(SPLITS, None) is None:  # both passes cut files alike, however many executors live by then
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = min(1 << 16, max(shuffle_partitions(spark), size // BUCKET_BYTES))

    def answer(table: pa.Table) -> pa.Table:
        asked = [_lists(_expand(x)) for x in table.column("words").to_pylist()]
        enc, ids = bpe.encoder(tokenizer_path), {}
        distinct = list(dict.fromkeys(w for words in asked for w in words))
        for at in range(0, len(distinct), 4096):
            part = distinct[at : at + 4096]
            found = enc.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            ids |= {w: np.array(x.ids, dtype).tobytes() for w, x in zip(part, found, strict=True)}
        out = [_squeeze(_joined([ids[w] for w in words])) for words in asked]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary()), table.column("text_sum")], names=["block", "bucket", "ids", "text_sum"])

    def fill(documents: pa.Table, answers: pa.Table) -> pa.Table:
        sums = [{x for x in t.column("text_sum").to_pylist() if x is not None} for t in (documents, answers)]
        if answers.num_rows and (sums[0] != sums[1] or len(sums[0]) != 1):
            raise RuntimeError("the two passes over the documents saw different blocks; write the documents to a table first")
        ids, first = [], np.zeros(buckets, np.int64)
        for k, found in zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            first[k] = len(ids)
            ids += _lists(_expand(found))
        keys, out = [], []
        for data in documents.column("data").to_pylist():
            head, *texts = _lists(_expand(data))
            keys += pa.ipc.read_record_batch(head, pa.schema([("k", pa.int64())])).column(0).to_pylist()
            for text in texts:
                numbers = np.frombuffer(text, "<u4").astype(np.int64)
                at = first[numbers % buckets] + numbers // buckets
                out.append(np.frombuffer(b"".join(map(ids.__getitem__, at.tolist())), dtype))
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        values = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        return pa.table([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["k", "ids"])

    lists = _blocks(rows, "words", buckets, block_words, block_bytes)
    answers = lists.groupBy("bucket").applyInArrow(answer, "block long, bucket int, ids binary, text_sum long")
    documents = _blocks(rows, "documents", buckets, block_words, block_bytes)
    filled = documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fill, "k long, ids array<int>")
    return filled.withColumnRenamed("k", key)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with column out: the pieces of ids, special ones too, joined by a space as the library does without a decoder.

    Null ids give null, no ids the empty text, and an id outside the vocabulary is left out, as the library leaves it.
    """
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column(part.num_columns - 1)
                known = pc.list_parent_indices(lists), pc.list_flatten(lists)
                keep = pc.and_kleene(pc.greater_equal(known[1], 0), pc.less(known[1], len(pieces)))
                found = pieces.take(pc.if_else(keep, known[1], pa.scalar(None, pa.int32())))
                keep = pc.is_valid(found)
                owner, found = known[0].filter(keep).to_numpy(zero_copy_only=False), found.filter(keep)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), " ")
                texts = pc.if_else(pc.is_valid(lists), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*part.schema.names[:-1], "decoded"])

    names = [c for c in rows.columns if c not in (ids, out)]
    fields = [rows.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())])
    return rows.select(*names, ids).mapInArrow(run, schema).withColumnRenamed("decoded", out)


def _pieces(path: str) -> pa.Array:
    """Piece by id, null where the vocabulary has no such id."""
    if path not in _PIECES:
        t = bpe.encoder(path).tokenizer
        vocabulary = t.get_vocab(with_added_tokens=True)
        out: list[str | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            out[i] = piece
        _PIECES[path] = pa.array(out, pa.string())
    return _PIECES[path]
