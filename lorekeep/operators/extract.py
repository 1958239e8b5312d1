"""Statements from text: segments, sentences, the five rules, and their units, provenance and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.workers import reachable
from lorekeep.plans import schema

BASE_CONFIDENCE = 0.6
MIN_BYTES, MAX_BYTES = 10, 400
MAX_SEGMENT_BYTES = 2000
#: Texts whose segments a Python worker holds at once.
SLICE = 128
# The sentence rules, in the order they are tried. Classes are Unicode's; a dot is anything but a line feed.
RULES = {
    "decision": r"(?iUd)\b(?:I|we)(?:'ve| have)?\s+(?:decided(?:\s+on|\s+to\s+(?:use|go\s+with))?|chose|picked|switched\s+to|will\s+use|agreed\s+(?:on|to\s+use)|(?:am|are)\s+going\s+with)\s+(.{2,80}?)[\s.]*\z",
    "temporal": r"(?iUd)^\s*(?:on|since|starting)\s+(\d{4}-\d{2}-\d{2})[,]?\s+(.{3,120}?)[\s.]*\z",
    "first_person": r"(?iUd)^\s*(?:I|we)\s+(?:(never|don't|do\s+not|no\s+longer)\s+)?(prefer|use|have|am|live\s+in|work\s+(?:at|for|on))\s+(.{2,80}?)[\s.]*\z",
    "definition": r"(?iUd)^\s*(.{2,60}?)\s+(?:means|is\s+defined\s+as|stands\s+for)\s+(.{2,120}?)[\s.]*\z",
    "numeric": r"(?iUd)^\s*(?:my|our|the)?\s*(.{2,60}?)\s+(?:is|costs?|takes?|weighs?)\s+(?:about\s+|around\s+|approximately\s+)?([$€£]?\d[\d,]*(?:\.\d+)?)\s*((?:[a-zA-Z%]+)?(?:\s+per\s+\w+)?)[\s.]*\z",
}
# Relation and kind of a first-person verb; others are works_at.
VERBS = {"prefer": ("preference", "prefers"), "use": ("fact", "uses"), "have": ("fact", "has"), "am": ("fact", "is")}


def plain_lower(sentence: Column) -> Column:
    """Lower case, with s and k also for the letters that equal them in any case."""
    return F.translate(F.lower(sentence), "\u017f\u212a", "sk")


def rule_of(sentence: Column, low: Column) -> Column:
    """struct(kind, subject, object, relation, pattern, value, unit, verb, negated, date) of a trimmed sentence, or null.

    low is the sentence in plain_lower().

    EXT-03..08: the first rule that matches decides, even if it then yields nothing.
    """
    got = lambda rule, group: F.regexp_extract(sentence, RULES[rule], group)
    verb = F.lower(got("first_person", 2))
    negated = got("first_person", 1) != ""
    relation = F.when(verb.startswith("live"), "lives_in").otherwise("works_at")
    kind = F.lit("fact")
    for name, (k, r) in VERBS.items():
        relation, kind = F.when(verb == name, r).otherwise(relation), F.when(verb == name, k).otherwise(kind)
    subject = X.tidy(got("numeric", 1))
    no = F.lit(None).cast("string")

    def unit(pattern: str, kind, subject, obj=no, relation=no, value=no, unit=no, verb=no, negated=F.lit(None).cast("boolean"), date=no) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        parts = {"kind": kind, "subject": subject, "object": obj, "relation": relation, "pattern": pattern, "value": value, "unit": unit, "verb": verb, "negated": negated, "date": date}
        return F.struct(*[lit(v).alias(k) for k, v in parts.items()])

    # A rule is tried only on sentences that have the characters it needs.
    has = lambda *parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    tried = {
        "decision": has("decided", "chose", "picked", "switched", "will", "agreed", "going"), "temporal": has("-") & has("on", "since", "starting"), "first_person": low.startswith("i") | low.startswith("we"),
        "definition": has("means", "defined", "stands"), "numeric": has("is", "cost", "take", "weigh") & sentence.rlike(r"\d"),
    }
    fits = lambda rule: tried[rule] & sentence.rlike(RULES[rule])
    return (
        F.when(fits("decision"), unit("decision", "decision", "Me", X.clean(got("decision", 1)), "decided_on"))
        .when(fits("temporal"), unit("temporal_event", "event", no, date=got("temporal", 1)))
        .when(fits("first_person"), unit("first_person", kind, "Me", F.when(~negated, X.clean(got("first_person", 3))), F.when(~negated, relation), verb=verb, negated=negated))
        .when(fits("definition"), unit("definition", "fact", X.tidy(got("definition", 1)), X.tidy(got("definition", 2)), "defined_as"))
        .when(fits("numeric") & (F.octet_length(subject) >= 3) & ~F.lower(subject).isin("it", "that", "this"), unit("numeric", "claim", subject, value=got("numeric", 2), unit=X.tidy(got("numeric", 3))))
    )


def extract_units(chunks: DataFrame, text: str = "text") -> DataFrame:
    """EXT-02..09: chunks with a row per unit: statement, the rule's fields, event_time, char_start, char_end, quote.

    One pass per sentence without a shuffle; offsets (bytes) are worked out only for sentences that gave a unit.
    """
    # Generators evaluate what they are given once for each row; as projections the rules would be repeated by each field
    # (and an inner generator of anything but an array would be repeated in a filter before it).
    sentence = lambda p: F.struct(p.alias("piece"), X.trimmed(p).alias("sentence"))
    rows = chunks.withColumn("_pieces", X.sentence_pieces(text)).select("*", F.posexplode_outer(F.transform("_pieces", sentence)).alias("_at", "_s"))
    rows = rows.select(*chunks.columns, "_pieces", "_at", F.col("_s.piece").alias("_piece"), F.col("_s.sentence").alias("_sentence")).where(F.octet_length("_sentence").between(MIN_BYTES, MAX_BYTES))
    rows = rows.withColumn("_low", plain_lower(F.col("_sentence"))).select("*", F.explode(F.array(rule_of(F.col("_sentence"), F.col("_low")))).alias("_unit")).where("_unit IS NOT NULL")
    start = X.bytes_before(F.col("_pieces"), F.col("_at"))
    return rows.select(
        *chunks.columns, "_unit.*", X.tidy(F.regexp_replace("_sentence", r"[.!?]+\z", "")).alias("statement"), start.alias("char_start"),
        (start + F.octet_length("_piece")).alias("char_end"), F.col("_sentence").alias("quote"), F.to_timestamp(F.try_to_date(F.col("_unit.date"), "yyyy-MM-dd")).alias("event_time"),
    )


def extract_llm_units(chunks: DataFrame, reply: str = "reply", text: str = "text") -> DataFrame:
    """EXT-15: units of a model's JSON reply {"units": [{kind, statement, subject, confidence, evidence}]}, checked.

    A unit needs a known kind, a statement, and evidence that occurs verbatim in the text; its confidence is 0.9 times
    the one given (0.5 if none), and its span that of the evidence, in bytes.
    """
    form = "struct<units:array<struct<kind:string,statement:string,subject:string,object:string,relation:string,confidence:double,evidence:string>>>"
    rows = chunks.withColumn("_u", F.explode(F.from_json(reply, form)["units"])).select(*[c for c in chunks.columns if c != reply], "_u.*")
    rows = rows.withColumn("statement", X.tidy("statement")).where(F.col("kind").isin(*schema.ENUMS["unit_kind"]) & (F.col("statement") != "") & (F.col("evidence") != "") & F.col(text).contains(F.col("evidence")))
    start = F.octet_length(F.substring(F.col(text), F.lit(1), F.instr(F.col(text), F.col("evidence")) - 1))
    rows = rows.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.octet_length("evidence")).withColumn("quote", X.trimmed("evidence"))
    return rows.withColumn("confidence", 0.9 * F.coalesce(F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(0.5))).drop("evidence")


def segments(docs: DataFrame, text: str = "text", limit: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """EXT-01, FN-26: docs with a row per segment: seq, heading, content.

    Markdown headings part sections and are dropped; a section over the limit is packed by paragraphs, and a paragraph
    over it is cut between characters. The fold over a text's paragraphs depends on its own output, so it is one Arrow
    pass; nothing is shuffled. A worker gives back the segments of SLICE texts at a time, so it holds no more than those
    beside the batch it was sent.
    """
    from lorekeep.functions.segmenting import segment_text

    reachable()

    @F.pandas_udf("array<struct<heading:string,content:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), SLICE):
                yield texts.iloc[at : at + SLICE].map(lambda t: [{"heading": h, "content": c} for h, c in segment_text(t or "", limit)])

    return docs.select("*", F.posexplode(cut(text)).alias("seq", "_s")).select(*docs.columns, "seq", "_s.heading", "_s.content")


def chunks_of(state: dict[str, DataFrame]) -> DataFrame:
    """JOIN-01..03, SET-06: unprocessed messages, segments and readable images as one table of chunks."""
    artifacts = state["artifacts"].select(F.col("id").alias("artifact_id"), "source_created_at", "ingested_at", "source_platform")
    time = lambda first: F.coalesce(first, "source_created_at", "ingested_at").alias("source_time")
    conversations = state["conversations"].select(F.col("id").alias("conversation_id"), "artifact_id")
    none = F.lit(None).cast("string")
    m = state["messages"].join(conversations, "conversation_id").join(artifacts, "artifact_id")
    m = m.select(F.lit("message").alias("anchor"), F.col("id").alias("anchor_id"), "artifact_id", F.col("content").alias("text"), F.col("role").alias("role"), time("created_at"), F.lit(None).cast("double").alias("ocr_confidence"))
    documents = state["documents"].select(F.col("id").alias("document_id"), "artifact_id")
    s = state["document_segments"].join(documents, "document_id").join(artifacts, "artifact_id")
    s = s.select(F.lit("segment").alias("anchor"), F.col("id").alias("anchor_id"), "artifact_id", F.col("content").alias("text"), none.alias("role"), F.coalesce("source_created_at", "ingested_at").alias("source_time"), F.lit(None).cast("double").alias("ocr_confidence"))
    i = state["images"].where(F.length(F.trim("ocr_text")) > 0).join(artifacts, "artifact_id")
    i = i.select(F.lit("image").alias("anchor"), F.col("id").alias("anchor_id"), "artifact_id", F.col("ocr_text").alias("text"), none.alias("role"), time("taken_at"), "ocr_confidence")
    return m.unionByName(s).unionByName(i)


def with_confidence(units: DataFrame) -> DataFrame:
    """EXT-10, EXT-11."""
    given = F.col("confidence") if "confidence" in units.columns else F.lit(BASE_CONFIDENCE)
    named = F.when(F.col("subject").isNotNull() & (F.col("subject") != "Me"), 0.1).otherwise(0.0)
    own = F.when(F.col("role") == "user", 0.1).otherwise(0.0)
    blurred = F.when(F.col("ocr_confidence") < 0.7, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given + named + own - blurred))
    return units.withColumn("confidence", F.round(score, 6)).withColumn("valid_from", F.coalesce("event_time", "source_time"))


def resolve_names(state: dict[str, DataFrame], names: DataFrame, now) -> tuple[dict[str, DataFrame], DataFrame]:
    """ENT-01, SET-03, JOIN-21: (state with new entities, names with entity_id).

    names has a column name. A live entity of that name, any case, comes first; then the head of an alias's owner; a name
    nobody has becomes an entity, of kind person only if it is exactly Me. Ties go to the least id.
    """
    wanted = names.select(X.trimmed("name").alias("name")).where("name <> ''").withColumn("key", F.lower("name"))
    first = wanted.groupBy("key").agg(F.min("name").alias("name"))
    entities = state["entities"]
    live = entities.where("merged_into_entity_id IS NULL").select(F.lower("name").alias("key"), F.col("id").alias("by_name")).groupBy("key").agg(F.min("by_name").alias("by_name"))
    owner = entities.select(F.col("id").alias("entity_id"), F.coalesce("merged_into_entity_id", "id").alias("head"))
    alias = state["entity_aliases"].join(owner, "entity_id").groupBy(F.lower("alias").alias("key")).agg(F.min("head").alias("by_alias"))
    found = first.join(live, "key", "left").join(alias, "key", "left").withColumn("new_id", X.uuid_of("entity", F.col("key")))
    found = found.withColumn("entity_id", F.coalesce("by_name", "by_alias", "new_id"))
    fresh = found.where("by_name IS NULL AND by_alias IS NULL")
    added = fresh.select(F.col("new_id").alias("id"), "name", F.when(F.col("name") == "Me", "person").otherwise("other").alias("kind"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"))
    added = schema.conform(added, "entities").join(entities.select("id"), "id", "left_anti").select(*entities.columns)
    out = wanted.join(found.select("key", "entity_id"), "key").select("name", "entity_id").distinct()
    return state | {"entities": schema.grown(entities, added)}, schema.settled(out)


def persist_units(state: dict[str, DataFrame], units: DataFrame, now, method: str = "rule_based", model: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """EXT-10..14: (state with units, provenance and edges, counts).

    Units are told apart by the hash of their normalised statement; the first (by source time, anchor, offset) fixes all
    fields, later ones only add provenance. Edges come with first assertions that have a subject; self loops are dropped.
    """
    units = schema.settled(with_confidence(units).withColumn("statement_hash", X.sha256_hex(X.normalize_statement("statement"))))
    state, ids = resolve_names(state, units.select(F.col("subject").alias("name")).union(units.select("object")).where("name IS NOT NULL"), now)
    ids = ids.select(F.lower("name").alias("k"), "entity_id").distinct()
    units = units.withColumn("sk", F.lower(X.trimmed("subject"))).withColumn("ok", F.lower(X.trimmed("object")))
    units = units.join(ids.select(F.col("k").alias("sk"), F.col("entity_id").alias("subject_entity_id")), "sk", "left").join(ids.select(F.col("k").alias("ok"), F.col("entity_id").alias("object_entity_id")), "ok", "left")
    order = Window.partitionBy("statement_hash").orderBy(F.col("source_time").asc_nulls_last(), "anchor_id", "char_start")
    ranked = units.withColumn("_rank", F.row_number().over(order)).withColumn("unit_id", X.uuid_of("unit", F.col("statement_hash")))
    ranked = schema.settled(ranked)
    first = ranked.where("_rank = 1").join(state["atomic_units"].select("statement_hash"), "statement_hash", "left_anti")
    stamp = F.lit(now).cast("timestamp")
    attrs = F.struct(*[(F.col(c) if c in units.columns else F.lit(None).cast("boolean" if c == "negated" else "string")).alias(c) for c in ("pattern", "value", "unit", "verb", "negated", "date")])
    new = first.select(F.col("unit_id").alias("id"), "kind", "statement", "statement_hash", "subject_entity_id", "confidence", F.lit(method).alias("extraction_method"), F.lit(model).cast("string").alias("extraction_model"), "valid_from", F.lit("active").alias("status"), attrs.alias("attrs"), stamp.alias("created_at"), stamp.alias("updated_at"))
    anchor = lambda kind: F.when(F.col("anchor") == kind, F.col("anchor_id"))
    provenance = ranked.select(
        X.uuid_of("provenance", F.col("unit_id"), F.col("anchor_id"), F.col("char_start"), F.col("char_end")).alias("id"), F.col("unit_id").alias("atomic_unit_id"), "artifact_id", anchor("message").alias("message_id"),
        anchor("segment").alias("segment_id"), anchor("image").alias("image_id"), "char_start", "char_end", "quote", stamp.alias("created_at"),
    )
    edges = first.where("subject_entity_id IS NOT NULL AND object_entity_id IS NOT NULL AND subject_entity_id <> object_entity_id").select(
        X.uuid_of("edge", F.col("subject_entity_id"), F.col("object_entity_id"), F.col("relation"), F.col("unit_id")).alias("id"), F.col("subject_entity_id").alias("source_entity_id"), F.col("object_entity_id").alias("target_entity_id"),
        F.col("relation").alias("relation_type"), F.col("unit_id").alias("atomic_unit_id"), "confidence", "valid_from", F.lit("active").alias("status"),
    )
    added = {"atomic_units": new, "atomic_unit_provenance": provenance, "relationships": edges}
    counts = new.select(F.lit("units").alias("what")).union(provenance.select(F.lit("provenance"))).union(edges.select(F.lit("edges"))).groupBy("what").count()
    return state | {t: schema.append_new(state[t], schema.conform(df, t), ["id"]) for t, df in added.items()}, counts


def extraction_pass(state: dict[str, DataFrame], now, processed: DataFrame | None = None, reader: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """EXT-16, EXT-17: one pass over chunks whose anchor is not in processed (anchor_id); returns (state, anchors done).

    reader may add a column reply (a model's JSON) to chunks; its units follow the rules' own.
    """
    chunks = chunks_of(state)
    if processed is not None:
        chunks = chunks.join(processed.select("anchor_id"), "anchor_id", "left_anti")
    state, _ = persist_units(state, extract_units(chunks), now)
    if reader is not None:
        state, _ = persist_units(state, extract_llm_units(reader(chunks)).withColumn("event_time", F.lit(None).cast("timestamp")), now, "llm_local")
    return state, chunks.select("anchor_id")


def embed_pending(rows: DataFrame, text: str, embedder: Callable, size: int) -> DataFrame:
    """EXT-18, ENT-12, SRC-24: rows whose embedding is null get one; embedder takes a list of texts and must answer each
    with a vector of the size, else the batch fails."""
    reachable()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        found = embedder(texts.tolist())
        if len(found) != len(texts) or any(len(v) != size for v in found):
            raise ValueError(f"the embedder must return {len(texts)} vectors of {size}")
        return pd.Series([list(map(float, v)) for v in found])

    missing = rows.where("embedding IS NULL").withColumn("embedding", embed(text))
    return rows.where("embedding IS NOT NULL").unionByName(missing)
