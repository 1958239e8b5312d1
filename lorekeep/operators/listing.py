"""Filtered listings and details (FLT-*, JOIN-05, JOIN-17, SRT-*), and the parameter rules they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    """Nothing has that id."""


class BadRequestError(ValueError):
    """A parameter is missing, unknown or in conflict."""


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    """FLT-14."""
    return max(low, min(high, default if value is None else value))


def page(rows: DataFrame, order: list, limit: int | None, offset: int | None) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset or 0)).limit(clamp(limit, 50, 1, 500))


def rpc_page(limit: int, offset: int) -> tuple[int | None, int]:
    """FLT-15: an unset (0 or less) remote limit means the default."""
    return (limit if limit > 0 else None), max(0, offset)


def _equal(rows: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def list_artifacts(state: dict[str, DataFrame], kind=None, source_platform=None, limit=None, offset=None) -> DataFrame:
    """FLT-01, SRT-01: newest first; the content itself is not read."""
    rows = _equal(state["artifacts"], kind=kind, source_platform=source_platform).drop("raw_content")
    return page(rows, [F.desc("ingested_at"), "id"], limit, offset)


def list_units(state: dict[str, DataFrame], kind=None, status=None, subject_entity_id=None, limit=None, offset=None) -> DataFrame:
    """FLT-02, JOIN-17, SRT-02: newest first, each with its count of provenance rows."""
    rows = page(_equal(state["atomic_units"], kind=kind, status=status, subject_entity_id=subject_entity_id).drop("embedding"), [F.desc("created_at"), "id"], limit, offset)
    counts = state["atomic_unit_provenance"].join(rows.select(F.col("id").alias("atomic_unit_id")), "atomic_unit_id", "left_semi").groupBy(F.col("atomic_unit_id").alias("id")).agg(F.count("*").alias("provenance_count"))
    return rows.join(counts, "id", "left").withColumn("provenance_count", F.coalesce("provenance_count", F.lit(0))).orderBy(F.desc("created_at"), "id")


def with_provenance(state: dict[str, DataFrame], units: DataFrame) -> DataFrame:
    """JOIN-05: units with an array of provenance rows, oldest first, each with its artifact's kind, platform and file."""
    a = state["artifacts"].select(F.col("id").alias("artifact_id"), F.col("kind").alias("artifact_kind"), "source_platform", "filename")
    p = state["atomic_unit_provenance"].join(units.select(F.col("id").alias("atomic_unit_id")), "atomic_unit_id", "left_semi").join(a, "artifact_id")
    one = F.struct("created_at", "id", "artifact_id", "artifact_kind", "source_platform", "filename", "message_id", "segment_id", "image_id", F.coalesce("char_start", F.lit(-1)).alias("char_start"), F.coalesce("char_end", F.lit(-1)).alias("char_end"), "quote")
    held = p.groupBy(F.col("atomic_unit_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("provenance"))
    return units.join(held, "id", "left")


def list_contradictions(state: dict[str, DataFrame], status=None, limit=None, offset=None) -> DataFrame:
    """FLT-03, JOIN-04, SRT-03, CON-12: by score, with both statements."""
    rows = page(_equal(state["contradictions"], status=status), [F.desc("score"), F.desc("detected_at"), "id"], limit, offset)
    side = lambda s: state["atomic_units"].select(F.col("id").alias(f"unit_{s}_id"), F.col("statement").alias(f"statement_{s}"), F.col("status").alias(f"status_{s}"))
    return rows.join(side("a"), "unit_a_id").join(side("b"), "unit_b_id").orderBy(F.desc("score"), F.desc("detected_at"), "id")


def list_entities(state: dict[str, DataFrame], q=None, kind=None, limit=None, offset=None, include_merged=False) -> DataFrame:
    """FLT-04, ENT-11, SRT-04: by name, with counts of aliases and of edges of any status; % and _ in q are wildcards."""
    rows = _equal(state["entities"], kind=kind).drop("embedding")
    rows = rows if include_merged else rows.where("merged_into_entity_id IS NULL")
    rows = page(rows if q is None else rows.where(F.col("name").ilike(f"%{q}%")), ["name", "id"], limit, offset)
    few = rows.select("id")
    aliases = state["entity_aliases"].groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("alias_count"))
    ends = state["relationships"].select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("id")).join(few, "id", "left_semi").groupBy("id").agg(F.count("*").alias("edge_count"))
    out = rows.join(aliases, "id", "left").join(ends, "id", "left")
    return out.withColumn("alias_count", F.coalesce("alias_count", F.lit(0))).withColumn("edge_count", F.coalesce("edge_count", F.lit(0))).orderBy("name", "id")


def as_json(rows: DataFrame) -> DataFrame:
    """FLT-13: rows with a column json, the row as an object of its non-null columns."""
    return rows.withColumn("json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))


def get_one(rows: DataFrame, id_: str, what: str) -> DataFrame:
    """FLT-05."""
    out = rows.where(F.col("id") == id_)
    if out.isEmpty():
        raise NotFoundError(f"{what} {id_}")
    return out


def get_artifact(state: dict[str, DataFrame], id_: str) -> DataFrame:
    """An artifact with its conversations (by start), its document and the count of that document's segments."""
    a = get_one(state["artifacts"].drop("raw_content"), id_, "artifact")
    c = state["conversations"].where(F.col("artifact_id") == id_).groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "id", "title"))).alias("conversations"))
    n = state["document_segments"].groupBy("document_id").agg(F.count("*").alias("segment_count"))
    d = state["documents"].where(F.col("artifact_id") == id_).select("artifact_id", F.col("id").alias("document_id"), "page_count", "extraction_status").join(n, "document_id", "left")
    d = d.withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))
    return a.join(c.withColumnRenamed("artifact_id", "id"), "id", "left").join(d.withColumnRenamed("artifact_id", "id"), "id", "left")


def get_entity(state: dict[str, DataFrame], id_: str) -> DataFrame:
    """ENT-10: an entity with its aliases and the merges it took part in on either side."""
    e = get_one(state["entities"], id_, "entity")
    a = state["entity_aliases"].where(F.col("entity_id") == id_).groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    m = state["entity_merge_audit"].where((F.col("winner_entity_id") == id_) | (F.col("loser_entity_id") == id_)).select(F.lit(id_).alias("id"), F.struct("created_at", F.col("id").alias("audit_id"), "action", "winner_entity_id", "loser_entity_id", "actor", "note").alias("m"))
    m = m.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("merges"))
    return e.join(a, "id", "left").join(m, "id", "left")
