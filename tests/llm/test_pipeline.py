"""Each stage against plain Python on a small corpus, and the whole pipeline against the stages."""

import re

import corpus_pipeline
import numpy as np
import pytest
from lorekeep.llm import langid, queries, toxicity
from pyspark.sql import functions as F
from test_classifiers import corpus, frame
from test_pii import brute
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus(250, seed=9)
    long = " ".join(f"{t}" for _, t, lang in rows[:12] if lang == "en")
    toxic = [(300 + i, f"{rows[i][1]} you idiot {rows[i][1]}", "en") for i in range(0, 80, 2)]
    odd = [(400, None, "en"), (401, "", "en"), (402, "%% 12", "en"), (403, long, "en"), (404, long + " x", "en"), (405, long, "en"), (403, long, "en"), (406, "mail me@x.yz the ing er and " + long[::-1], "en")]
    frame(spark, [*rows, *toxic, *odd]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in [*range(0, 250, 2), *range(300, 380, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = queries.read(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_dedup", "pii", "packing"]

    model = langid.fit(docs.where(F.coalesce(langid.fold(3) != 1, F.lit(False))))
    out = stages["language"](spark, docs, folder)
    assert out.columns == COLUMNS
    want = sorted(tuple(r) for r in docs.collect() if not model.predict([r.text])[2][0])
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) == docs.count() - 3

    tox = toxicity.fit(docs, queries.read(spark, folder, "labels").where(langid.fold(5) != 0))
    out = stages["toxicity"](spark, docs, folder)
    want = sorted((tuple(r) for r in docs.collect() if tox.score(r.text) < 0.5), key=str)
    assert out.columns == COLUMNS and sorted((tuple(r) for r in out.collect()), key=str) == want
    assert not any("idiot" in (t[1] or "") for t in want) and len(want) > 250

    out = stages["near_dedup"](spark, docs, folder)
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [(a, b) for a in sets for b in sets if like(a, b)]
    root = dict(zip(sets, sets, strict=True))
    while any(root[a] != root[b] for a, b in near):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(k for k, v in root.items() if k == v)

    out = stages["pii"](spark, docs, folder)
    assert out.columns == COLUMNS and out.count() == docs.count()
    for r in out.join(docs.select("doc_id", F.col("text").alias("was")).distinct(), "doc_id").collect():
        if r.text != r.was:
            assert not brute(r.text) and r.n_chars == len(r.text) and re.search("<(email|ip|card|phone|secret|context)>", r.text)
        else:
            assert not brute(r.was or "")

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = {}
    for r in stages["packing"](spark, docs.dropDuplicates(["doc_id"]), folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in docs.collect():
        assert [x for _, ids in sorted(got[r.doc_id]) for x in ids] == [*library.encode(r.text or "", add_special_tokens=False).ids, 1]


def test_run_is_the_stages_in_order(spark, folder):
    docs = queries.read(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "start", "length", "doc_tokens"]
    want = sorted(tuple(r) for r in docs.select(*key).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select(*key).collect()) == want and want


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
