import hashlib

from helpers import awkward, docs
from lorekeep.llm import queries, word_table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = queries.tokenizer("word_bpe_49k.json")


def test_ids_and_decoded_texts_are_the_librarys(spark, tmp_path):
    library, texts = Tokenizer.from_file(WORD), [x for s in range(6) for x in awkward(s)]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_word_table(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_small_blocks_repeated_rows_and_unstable_input(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(i % 5 if i % 7 else None, t) for i, t in enumerate(awkward())]
    shuffled = docs(spark, rows).withColumnRenamed("lang", "ids").repartition(4, F.rand(1)).withColumn("data", F.lit(1))
    got = sorted(((r.doc_id, r.ids) for r in word_table.encode(shuffled, WORD, block_words=5, block_bytes=2000).collect()), key=str)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)


def test_empty_table_and_odd_ids(spark):
    assert word_table.encode(docs(spark, []), WORD).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6, 49407, -1])], "text long, ids array<int>")
    library = Tokenizer.from_file(WORD)
    got = {r.k: r.out for r in word_table.decode(rows.withColumnRenamed("text", "k"), WORD, out="out").collect()}
    assert got == {1: None, 2: "", 3: library.decode([320, 49407], skip_special_tokens=False)}
