"""The tables of the engine, their enumerations, keys and row constraints.

State is a dict from table name to DataFrame; every mutation takes one and returns another. Ids are uuid-shaped strings
made from natural keys, so reruns are idempotent. Times are UTC; confidences and scores are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns by table, in the order in which tables depend on each other.
TABLES = {
    "ingestion_jobs": "id string, source string, status string, started_at timestamp, finished_at timestamp, stats map<string,bigint>",
    "artifacts": "id string, ingestion_job_id string, kind string, source_platform string, source_format string, filename string, media_type string, byte_size bigint, content_hash string, raw_content binary, version int, supersedes_artifact_id string, source_created_at timestamp, ingested_at timestamp, metadata map<string,string>",
    "conversations": "id string, artifact_id string, external_id string, title string, model string, source_platform string, started_at timestamp, ended_at timestamp",
    "messages": "id string, conversation_id string, parent_message_id string, external_id string, seq int, role string, author string, model string, content string, created_at timestamp",
    "documents": "id string, artifact_id string, page_count int, language string, extracted_text string, extraction_tool string, extraction_status string",
    "document_segments": "id string, document_id string, seq int, page int, heading string, content string, content_hash string, embedding array<float>",
    "images": "id string, artifact_id string, width int, height int, exif map<string,string>, taken_at timestamp, ocr_text string, ocr_confidence double, ocr_status string, caption string",
    "entities": "id string, name string, kind string, description string, merged_into_entity_id string, embedding array<float>, created_at timestamp, updated_at timestamp",
    "entity_aliases": "id string, entity_id string, alias string",
    "atomic_units": "id string, kind string, statement string, statement_hash string, subject_entity_id string, confidence double, extraction_method string, extraction_model string, embedding array<float>, valid_from timestamp, valid_to timestamp, status string, superseded_by_unit_id string, attrs struct<pattern:string,value:string,unit:string,verb:string,negated:boolean,date:string>, created_at timestamp, contradiction_scanned_at timestamp, updated_at timestamp",
    "atomic_unit_provenance": "id string, atomic_unit_id string, artifact_id string, message_id string, segment_id string, image_id string, char_start int, char_end int, quote string, created_at timestamp",
    "relationships": "id string, source_entity_id string, target_entity_id string, relation_type string, atomic_unit_id string, confidence double, valid_from timestamp, valid_to timestamp, status string",
    "contradictions": "id string, unit_a_id string, unit_b_id string, score double, detection_method string, explanation string, status string, detected_at timestamp, resolved_at timestamp, resolved_by string, resolution_note string, updated_at timestamp",
    "contradiction_audit": "id string, contradiction_id string, action string, actor string, from_status string, to_status string, note string, created_at timestamp",
    "entity_merge_audit": "id string, winner_entity_id string, loser_entity_id string, action string, actor string, note string, created_at timestamp",
}
# Members of each enumeration.
ENUMS = {
    "artifact_kind": ("chat_export", "agent_log", "document_pdf", "document_markdown", "document_text", "image_photo", "image_screenshot"),
    "ingestion_status": ("pending", "processing", "completed", "partial", "failed"),
    "extraction_status": ("pending", "processing", "completed", "failed", "skipped"),
    "unit_kind": ("fact", "claim", "decision", "preference", "event"),
    "unit_status": ("active", "superseded", "retracted", "disputed"),
    "extraction_method": ("rule_based", "llm_local", "manual"),
    "entity_kind": ("person", "organization", "project", "tool", "concept", "location", "event", "other"),
    "contradiction_status": ("open", "resolved_a", "resolved_b", "both_valid", "dismissed"),
}
#: Unique keys beyond the id; rows whose key has a null are not held to it.
UNIQUE = {
    "artifacts": ("content_hash",), "conversations": ("artifact_id", "external_id"), "documents": ("artifact_id",), "images": ("artifact_id",),
    "document_segments": ("document_id", "seq"), "atomic_units": ("statement_hash",), "contradictions": ("unit_a_id", "unit_b_id"),
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    from lorekeep.plans.store import State

    return State({name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns, in order and type; missing ones are null."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(TABLES[table]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def append_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """MUT-01, JOIN-16: existing and those rows whose key it does not have; of rows with one key the first by id stays."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[rows[c] for c in rows.columns]), rows["id"]).alias("row")).select("row.*")
    fresh = first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)
    return grown(existing, fresh)


def grown(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """existing and a written copy of rows; a store that has existing already takes only the rows."""
    from lorekeep.plans.store import appended

    return appended(existing, settled(rows.select(*existing.columns)))


def touched(df: DataFrame, changed: Column, now) -> DataFrame:
    """MUT-05: df with updated_at now where a row was changed; unknown counts as not changed."""
    return df.withColumn("updated_at", F.when(F.coalesce(changed, F.lit(False)), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")))


def one_row(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with a column for each of the given one-row, one-column (n) tables."""
    rows = None
    for name, df in counts.items():
        part = df.select(F.lit(name).alias("what"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in counts])


def settled(df: DataFrame) -> DataFrame:
    """A written copy: what a mutation adds or rewrites is stored, so the plans of a long run of mutations stay small."""
    from lorekeep.plans.store import checkpointed

    return checkpointed(df)


def _rules(table: str) -> dict[str, Column]:
    c = F.col
    if table == "messages":
        return {"role": c("role").isin("system", "user", "assistant", "tool", "function", "other")}
    if table == "artifacts":
        return {"kind": c("kind").isin(*ENUMS["artifact_kind"]), "byte_size": c("byte_size") >= 0, "version": c("version") >= 1}
    if table == "images":
        return {"ocr_confidence": c("ocr_confidence").between(0, 1)}
    if table == "atomic_units":
        return {"kind": c("kind").isin(*ENUMS["unit_kind"]), "confidence": c("confidence").between(0, 1), "window": c("valid_to") >= c("valid_from")}
    if table == "atomic_unit_provenance":
        return {"one_anchor": c("message_id").isNotNull().cast("int") + c("segment_id").isNotNull().cast("int") + c("image_id").isNotNull().cast("int") <= 1}
    if table == "relationships":
        return {"self_loop": c("source_entity_id") != c("target_entity_id"), "confidence": c("confidence").between(0, 1)}
    if table == "contradictions":
        return {"ordered": c("unit_a_id") < c("unit_b_id"), "score": c("score").between(0, 1)}
    return {"winner": c("winner_entity_id") != c("loser_entity_id")} if table == "entity_merge_audit" else {}


def violations(state: dict[str, DataFrame]) -> DataFrame:
    """FLT-16, MUT-08: (table_name, rule, n) with a row for each rule that some row breaks; unknown values break none."""
    spark = next(iter(state.values())).sparkSession
    parts = []
    for table, df in state.items():
        counts = [F.count_if(~rule).alias(name) for name, rule in _rules(table).items()]
        for name, agg in zip(_rules(table), counts, strict=True):
            parts.append(df.agg(agg.alias("n")).select(F.lit(table).alias("table_name"), F.lit(name).alias("rule"), "n"))
        if key := UNIQUE.get(table):
            again = df.dropna(subset=list(key)).groupBy(*key).count().where(F.col("count") > 1)
            parts.append(again.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"), "n"))
    out = spark.createDataFrame([], "table_name string, rule string, n bigint")
    for p in parts:
        out = out.unionByName(p)
    return out.where("n > 0")
