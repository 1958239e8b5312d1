"""The thin queries op1 ... op10 and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, cover_tree, langid, packing, pii, scaled_sketch, simhash, token_blocks, toxicity, word_table
from .common import prepare, scratch_dir


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; LOREKEEP_TOKENIZERS names another folder."""
    folder = os.environ.get("LOREKEEP_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/lorekeep/token-blocks-{uuid.uuid4().hex[:12]}"
    token_blocks.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_blocks.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_trees.format_paths(chat_trees.paths(chat_trees.reply_chains(rows), per_tree=1), trained="assistant")
    out = out.select(F.col("tree").alias("conv_id"), "formatted", chat_trees.parsed(F.col("formatted")).alias("turns"), chat_trees.masked(F.col("formatted"), F.col("loss")).alias("under"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) + 14 AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
walk(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, (SELECT min(b) FROM walk WHERE walk.a = v.vec_id) AS component_id, (SELECT min(b) FROM walk WHERE walk.a = v.vec_id) = v.vec_id AS kept FROM v
"""


def op5_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    encoded = word_table.encode(read(spark, sf_dir, "documents"), path)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return word_table.decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), F.coalesce(langid.fold(5) == 0, F.lit(False))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), F.coalesce(langid.fold(3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, seed=42, within=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.edited_report(read(spark, sf_dir, "documents"), words=5, fraction=1 / 8)


QUERIES = {"op2_reply_trees": op2_reply_trees, "op3_pii": op3_pii, "op4_cover_tree": op4_cover_tree, "op1_token_blocks": op1_token_blocks, "op5_word_table": op5_word_table, "op6_toxicity": op6_toxicity, "op7_language_id": op7_language_id, "op8_packing": op8_packing, "op9_simhash": op9_simhash, "op10_scaled_sketch": op10_scaled_sketch}
ORACLE_SQL: dict[str, str] = {"op2_reply_trees": OP2_SQL, "op4_cover_tree": OP4_SQL}
