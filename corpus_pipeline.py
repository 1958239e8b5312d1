"""A training corpus from documents: language, toxicity, near-duplicates, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all documents it is given, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import langid, packing, pii, queries, simhash, toxicity
from lorekeep.llm.common import prepare, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, or far from every language, go."""
    prepare(spark)
    model = langid.fit(docs.where(F.coalesce(langid.fold(3) != 1, F.lit(False))))
    return langid.predict(docs, model).where(~F.col("lang_rejected")).select(*[f"`{c}`" for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity under 0.5, by a classifier of the labels outside the held-out fold."""
    labels = queries.read(spark, sf_dir, "labels").where(F.coalesce(langid.fold(5) != 0, F.lit(False)))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where("toxicity < 0.5").select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: five-word shingles, at most 6 of 64 bits apart, and at least
    0.8 alike in their shingle sets."""
    return simhash.deduplicated(docs, shingle=5, within=6, parts=4, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind."""
    prepare(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of 2048."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), length=2048, end_id=1)


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", near_dedup), ("pii", private), ("packing", pack)]
#: Models and tokenizers cannot be expressed in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
