"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, lang="en"):
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)


def awkward(seed=1, n=40):
    r = random.Random(seed)
    letters = ["a", "b", "É", "é", "ß", "İ", " ", "\u0085", "\x1c", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "12", "3.5", "<|endoftext|>", "<|startoftext|>", "漢字", "😀", "\u00a0", "\u2003", "\u3000", "!?", "_", "​", "the ", "Word ", "Straße, ", "ÉTÉ. ", "e\u0301", "(x) ", "a-b ", "... ", "x*** ", "É$_&% ", "`{}~ ", "a[b]\\ "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [None, "", " ", "\n", "  x", "x  ", "a \n b", "x" * 5000, "word " * 3000, *texts, texts[0], texts[0]]
