import zlib

import numpy as np
import pytest
from helpers import awkward, docs
from lorekeep.llm import packing, queries, token_blocks
from lorekeep.llm.bpe import Encoder
from tokenizers import Tokenizer

WORD, BYTE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "kind"), [(WORD, "drop"), (BYTE, "attach")])
def test_cut_texts_encode_as_whole_ones(path, kind):
    enc, library = Encoder(path, limit=50), Tokenizer.from_file(path)
    assert enc.kind == kind
    for text in [x for s in range(30) for x in awkward(s)]:
        got = np.frombuffer(enc.encode((text or "").encode()), enc.dtype).tolist()
        assert got == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("top", [1, 2, 300, 2**31, 2**32 - 1])
def test_segment_round_trip(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[r.random(n) < 0.02] = 2**32 - 1
    s = token_blocks.Segment(token_blocks.encode_segment([None, 5], np.array([n, 0]), ids))
    assert s.doc_ids == [None, 5]
    assert s.ids().tolist() == ids.tolist()
    assert [x for i in range(len(s.low)) for x in s.block(i).tolist()] == ids.tolist()


def test_narrow_blocks_keep_outliers_as_exceptions():
    ids = np.full(256, 1000, np.uint32)
    ids[::2] += 3
    ids[[5, 200]] = 49_000
    s = token_blocks.Segment(token_blocks.encode_segment([1], np.array([256]), ids))
    assert s.width.tolist() == [2, 2] and s.position.tolist() == [5, 72] and s.ids().tolist() == ids.tolist()


def test_written_ids_are_the_librarys(spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    rows = [(7 * i % 61, t) for i, t in enumerate(awkward())]
    want = sorted((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    path = f"file://{tmp_path}/tokens"
    token_blocks.write_tokens(docs(spark, rows).withColumnRenamed("lang", "ids"), path, WORD)
    got = token_blocks.read_tokens(spark, path).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()


def test_empty_table_and_null_ids(spark, tmp_path):
    token_blocks.write_tokens(docs(spark, []), f"file://{tmp_path}/none", WORD)
    assert token_blocks.read_tokens(spark, f"file://{tmp_path}/none").count() == 0
    token_blocks.write_tokens(docs(spark, [(None, "a"), (3, "b"), (None, "c")]), f"file://{tmp_path}/nulls", WORD)
    assert [r.doc_id for r in token_blocks.read_tokens(spark, f"file://{tmp_path}/nulls").orderBy("start").collect()] == [None, None, 3]


def test_tournament_is_first_fit_decreasing():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 33, 200):
        sizes = r.integers(1, 101, n).tolist()
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(n)]


def test_packed_pieces_hold_each_id_once(spark):
    library = Tokenizer.from_file(BYTE)
    texts = awkward() * 3
    rows = packing.pack(docs(spark, texts), BYTE, length=64, group_docs=20).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i])
        assert [x for p in pieces for x in p[1]] == want and {p[2] for p in pieces} == {len(want)}
        assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[1]) for p in pieces)])[:-1].tolist()
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    used = sum(r.length for r in rows)
    assert used / (64 * len(by_sequence)) > 0.9
    assert packing.pack(docs(spark, []), BYTE).count() == 0


def test_queries_over_a_fixture(spark, tmp_path):
    d = docs(spark, awkward())
    d.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.start): r for r in queries.op8_packing(spark, str(tmp_path)).collect()}
    library = Tokenizer.from_file(BYTE)
    for (doc, start), r in rows.items():
        ids = [*library.encode(awkward()[doc] or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == crc(ids[start : start + r.length])
    library = Tokenizer.from_file(WORD)
    for r in queries.op1_token_blocks(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == crc([*library.encode(awkward()[r.doc_id] or "", add_special_tokens=False).ids, 1])
