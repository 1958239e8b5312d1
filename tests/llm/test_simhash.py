import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, docs
from lorekeep.llm import simhash
from lorekeep.llm.common import connected_components
from pyspark.sql import functions as F


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_match_brute_force():
    for t in [x or "" for s in range(5) for x in awkward(s)]:
        assert simhash.fingerprint_of(t.encode(), 3, 42) == brute_fingerprint(t), repr(t[:80])


@pytest.mark.parametrize("group", [2048, 4])
def test_components_match_brute_force(spark, group):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(4)]
    hot = [(7 << 50) ^ sum(1 << k for k in r.sample(range(12), 2)) for _ in range(60)]  # one dense group
    values = sorted({int(np.uint64(v).view(np.int64)) for v in [*base, *near, *hot, 0]})
    want = components(values, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.linked(fps, 2, 3, group)
    for a, b in edges.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_thresholds_are_the_cheapest_lossless_choice():
    costs = [[0, 100, 500, 900], [0, 1, 2, 30], [0, 1, 2, 30]]
    chosen = simhash.thresholds(costs, 0)
    assert sum(chosen) == 0 and chosen[0] == -1 and sorted(chosen[1:]) == [0, 1]


def test_documents_with_copies_and_empty_texts(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 900)}" for _ in range(400))
    texts = ["", None, " \n", long, long + " end", "A b", "a B", long, "other words here entirely different", "漢字 漢字"]
    rows = [(9 - i, t) for i, t in enumerate(texts)] + [(9, "")]
    got = sorted((x.doc_id, x.fp, x.component_id) for x in simhash.near_duplicates(docs(spark, rows).withColumnRenamed("source", "fp"), group=2).collect())
    fp = {i: int(np.uint64(brute_fingerprint(t or "")).view(np.int64)) for i, t in rows}
    roots = components(sorted(set(fp.values())), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    first = {}
    for i, f in sorted(fp.items()):
        first.setdefault(roots[f], i)
    assert got == sorted((i, fp[i], first[roots[fp[i]]]) for i, _ in rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (501, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got.get(500, 500) == 500


def test_one_document_of_each_group_stays(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randint(0, 900)}" for _ in range(500))
    rows = [(5, long), (3, long), (9, long + " x"), (3, long), (4, "a quite different text of some words"), (None, long), (None, "alone without id"), (None, "alone without id"), (7, None), (8, "")]
    got = simhash.deduplicated(docs(spark, rows).withColumnRenamed("source", "fp"))
    assert got.columns == ["doc_id", "text", "lang", "fp", "n_chars"]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(3, long), (4, "a quite different text of some words"), (None, "alone without id"), (7, None)], key=str)


def brute_kept(rows, shingle=5, similarity=0.8):
    """Ids that stay of (doc_id, text) with distinct ids: every pair is tested."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    return sorted(i for i, v in components(sorted(sets), near).items() if i == v)


def edited_copies(n, words, edits, seed):
    r = random.Random(seed)
    text = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(text)
        for k in r.sample(range(words), r.randint(1, edits)):
            copy[k] = f"e{r.randint(0, 10**6)}"
        out.append((i, " ".join(copy)))
    return out


def test_every_verified_link_joins_a_group(spark, monkeypatch):
    rows = edited_copies(300, 200, 10, seed=6)
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(spark, rows)).collect()) == want
    monkeypatch.setattr(simhash.alike, "__defaults__", (40,))  # roots in many blocks
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(spark, rows)).collect()) == want


def test_equal_fingerprints_need_alike_texts(spark):
    line = "total total total total total " * 16
    rows = [(i, line + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(3)]
    rows += [(10, rows[1][1].upper()), (11, rows[2][1] + " end")]
    assert len({simhash.fingerprint_of(t.encode(), 5, 42) for _, t in rows}) == 1
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(spark, rows)).collect()) == brute_kept(rows) == [0, 1, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 10**6])
def test_masks_stay_few(n):
    parts = simhash.correlated_parts(0, np.zeros((64, 64)), list(range(64)), 4)
    costs = [[0.0, *(max(n, 1) * simhash.comb(len(b), t) for t in range(7))] for b in parts]
    chosen = simhash.thresholds(costs, 3)
    assert sum(chosen) == 3 and sum(simhash.comb(16, t) for t in chosen if t >= 0) <= 49


@pytest.mark.parametrize("texts", [[], ["one text of a few words"], [None], ["one text of a few words"] * 2, ["a b c d e f", "other words stand in this text"], ["", None]])
def test_tiny_tables(spark, texts):
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(spark, texts)).collect()) == brute_kept(list(enumerate(texts)))


def test_pairs_of_least_likeness_are_found(spark):
    """Pairs just above 0.8, most of which lie more than 6 bits apart: nine in ten must be found."""
    r, rows = random.Random(8), []
    for i in range(120):
        text = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(60, 400))]
        copy = list(text)
        for k in r.sample(range(0, len(text), 5), max(1, len(text) // 60)):
            copy[k] = f"e{r.randint(0, 10**6)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    want, got = brute_kept(rows), {x.doc_id for x in simhash.deduplicated(docs(spark, rows)).collect()}
    assert set(want) <= got and len(rows) - len(got) >= 0.9 * (len(rows) - len(want)) > 50


@pytest.mark.parametrize("group", [2048, 5])
def test_band_links_join_copies_only(spark, group):
    rows = [*edited_copies(40, 200, 4, seed=1), *((100 + i, t) for i, t in edited_copies(2, 200, 4, seed=2)), (200, "alone in the world with these words"), (201, "")]
    texts = simhash.fingerprints(docs(spark, rows), 5, 42, banded=True).select(F.col("doc_id").alias("th"), "least")
    got = {r.node: r.root for r in connected_components(simhash.band_links(texts, group)).collect()}
    assert got == {i: 0 if i < 100 else 100 for i in [*range(40), 100, 101]}


def test_clashing_columns(spark):
    table = docs(spark, ["a b c d e f", "a b c d e f", "else"]).withColumn("_th", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("Root", F.lit(2))
    got = simhash.deduplicated(table)
    assert got.columns == table.columns and sorted((r["doc_id"], r["_th"], r["a.b"], r["Root"]) for r in got.collect()) == [(0, "x", 1, 2), (2, "x", 1, 2)]


def test_blocks_of_one_root_meet_in_several_tasks(spark):
    """However the sizes of roots are joined, the pairs of blocks are dealt by (root, i, j) and not by root alone."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + f" end{i}") for i in range(12)], "doc_id long, text string")
    firsts = docs.select(F.xxhash64("text").alias("th"), F.lit(7).cast("long").alias("root"), "doc_id")
    for bound in (simhash.BROADCAST_KEYS, -1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "BROADCAST_KEYS", bound)
            edges = simhash.alike(docs, firsts, 5, 0.8, block=3)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(root" in plan and any(", i#" in line and ", j#" in line for line in plan.split("\n") if "hashpartitioning(root" in line)
        assert connected_components(edges).select("root").distinct().count() == 1
        assert connected_components(edges).count() == 12
