"""Content-addressed ingest of exports, logs and files (SRC-10..16, FN-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators.extract import segments
from lorekeep.plans import schema
from lorekeep.sources import adapters

# Media types by file extension, and artifact kinds by media type.
EXTENSIONS = {"pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "log": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "heic": "image/heic", "heif": "image/heif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}
KINDS = {"application/pdf": "document_pdf", "text/markdown": "document_markdown", "text/plain": "document_text", "image/png": "image_screenshot", "image/jpeg": "image_photo", "image/heic": "image_photo", "image/heif": "image_photo", "image/webp": "image_photo", "image/tiff": "image_photo"}
EXPLICIT = ("document_pdf", "document_markdown", "document_text", "image_photo", "image_screenshot")


def start_job(state: dict[str, DataFrame], source: str, now) -> tuple[dict[str, DataFrame], str]:
    """SRC-12."""
    spark = state["ingestion_jobs"].sparkSession
    row = spark.createDataFrame([(source,)], "source string").select(X.uuid_of("job", F.col("source"), F.lit(now).cast("timestamp")).alias("id"), "source", F.lit("processing").alias("status"), F.lit(now).cast("timestamp").alias("started_at"))
    return state | {"ingestion_jobs": schema.grown(state["ingestion_jobs"], schema.conform(row, "ingestion_jobs"))}, row.first().id


def finish_job(state: dict[str, DataFrame], job: str, stats: dict[str, int], now, ok: bool = True) -> dict[str, DataFrame]:
    jobs = state["ingestion_jobs"]
    mine = F.col("id") == job
    counts = F.create_map(*[F.lit(x) for kv in stats.items() for x in kv]).cast("map<string,bigint>") if stats else F.lit(None)
    new = {"status": F.lit("completed" if ok else "partial"), "finished_at": F.lit(now).cast("timestamp"), "stats": counts}
    return state | {"ingestion_jobs": jobs.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])}


def store_artifacts(state: dict[str, DataFrame], incoming: DataFrame, now, job: str | None = None, hashed: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC-11, STR-08: (state, incoming with artifact_id and deduplicated).

    incoming has content (binary) and any artifact columns. Content is known by its hash: what the store or an earlier
    row (by filename) has is not stored again. Contents are grouped by hash only, and cross the network once. hashed: incoming
    has content_hash already, as stored by the caller, so what needs no content reads none.
    """
    rows = (incoming if hashed else incoming.withColumn("content_hash", F.sha2("content", 256))).withColumn("artifact_id", X.uuid_of("artifact", F.col("content_hash")))
    order = F.coalesce(F.col("filename"), F.lit("")) if "filename" in rows.columns else F.lit("")
    known = state["artifacts"].select("content_hash", F.lit(True).alias("_known"))
    firsts = rows.groupBy("content_hash").agg(F.min(order).alias("_first"))
    rows = rows.join(firsts, "content_hash").join(known, "content_hash", "left")
    rows = rows.withColumn("deduplicated", F.coalesce("_known", F.lit(False)) | (order != F.col("_first"))).drop("_known", "_first")
    new = rows.where(~F.col("deduplicated")).dropDuplicates(["content_hash"]).withColumn("id", F.col("artifact_id")).withColumn("raw_content", F.col("content"))
    new = new.withColumn("byte_size", F.octet_length("content").cast("bigint")).withColumn("version", F.lit(1)).withColumn("ingested_at", F.lit(now).cast("timestamp")).withColumn("ingestion_job_id", F.lit(job).cast("string"))
    return state | {"artifacts": schema.grown(state["artifacts"], schema.conform(new, "artifacts"))}, rows


def persist_conversations(state: dict[str, DataFrame], normalized: DataFrame, platform: str) -> dict[str, DataFrame]:
    """SRC-13, JOIN-24, WIN-05: rows of normalize() with artifact_id to conversations and messages.

    A message's parent is the earlier message of the same conversation with that external id, if there is one.
    """
    rows = normalized.where("error IS NULL").withColumn("id", X.uuid_of("conversation", F.col("artifact_id"), F.coalesce("external_id", F.concat(F.lit("#"), F.col("position").cast("string"))))).withColumn("source_platform", F.lit(platform))
    conversations = schema.append_new(state["conversations"], schema.conform(rows, "conversations"), ["id"])
    told = rows.select(F.col("id").alias("conversation_id"), F.posexplode("messages").alias("seq", "m")).select("conversation_id", "seq", "m.*").withColumn("id", X.uuid_of("message", F.col("conversation_id"), F.col("seq")))
    before = told.select("conversation_id", F.col("external_id").alias("parent_external_id"), F.col("seq").alias("_seq"), F.col("id").alias("_pid")).where("parent_external_id IS NOT NULL")
    parents = told.select("id", "conversation_id", "parent_external_id", "seq").join(before, ["conversation_id", "parent_external_id"]).where("_seq < seq").groupBy("id").agg(F.max_by("_pid", "_seq").alias("parent_message_id"))
    messages = schema.append_new(state["messages"], schema.conform(told.join(parents, "id", "left"), "messages"), ["id"])
    return state | {"conversations": conversations, "messages": messages}


def chat_export(state: dict[str, DataFrame], raw: DataFrame, platform: str, now, source: str = "batch") -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC-10: (state, one row of counts). raw has payload (JSON text) and may have filename; bad payloads store nothing.

    Payloads are parsed once, and from then on known by their hash: what is compared, counted or joined holds no text.
    """
    rows = schema.settled(raw.withColumn("content_hash", F.sha2(F.encode("payload", "UTF-8"), 256)))
    normalized = schema.settled(adapters.normalize(platform, rows))
    good = normalized.where("error IS NULL").select("content_hash").distinct()
    stored = rows.join(good, "content_hash", "left_semi").withColumn("content", F.encode("payload", "UTF-8")).withColumn("kind", F.lit("chat_export")).withColumn("source_platform", F.lit(platform)).withColumn("media_type", F.lit("application/json")).drop("payload")
    state, job = start_job(state, source, now)
    state, kept = store_artifacts(state, stored, now, job, hashed=True)
    fresh = kept.where(~F.col("deduplicated")).select("content_hash", "artifact_id").distinct()
    new = schema.settled(normalized.join(fresh, "content_hash").drop("content_hash"))
    state = persist_conversations(state, new, platform)
    parts = {"conversations": new.agg(F.count("*").alias("n")), "messages": new.agg(F.sum(F.size("messages")).alias("n")), "deduplicated": kept.agg(F.count_if("deduplicated").alias("n")), "rejected": normalized.agg(F.count("error").alias("n"))}
    counts = schema.one_row(parts)
    return finish_job(state, job, counts.first().asDict(), now), counts


def ingest_agent_log(state: dict[str, DataFrame], lines: DataFrame, platform: str, now) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC-09 into the store: lines has session, title, line and value; each session is one artifact."""
    sessions = adapters.agent_log(lines)
    text = lines.groupBy("session", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("_text"))
    rows = sessions.where("error IS NULL").join(text, ["session", "title"]).select(F.encode("_text", "UTF-8").alias("content"), F.col("session").alias("filename"), F.lit("agent_log").alias("kind"), F.lit(platform).alias("source_platform"), F.lit("application/x-ndjson").alias("media_type"), "title", "messages", F.create_map(F.lit("session_id"), F.col("session")).alias("metadata"))
    state, kept = store_artifacts(state, rows, now)
    null = F.lit(None)
    new = kept.where(~F.col("deduplicated")).select("artifact_id", F.lit(0).alias("position"), F.col("filename").alias("external_id"), "title", null.cast("string").alias("model"), null.cast("timestamp").alias("started_at"), null.cast("timestamp").alias("ended_at"), "messages", null.cast("string").alias("error"))
    return persist_conversations(state, new, platform), sessions.select("session", "error")


def media_type(filename: Column, declared: Column) -> Column:
    """SRC-15: the declared type unless it says nothing, else what the extension says."""
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    types = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    guess = F.coalesce(F.element_at(types, ext), F.lit("application/octet-stream"))
    return F.when(declared.isNotNull() & (declared != "application/octet-stream"), declared).otherwise(guess)


def classify(part: Column, filename: Column, declared: Column) -> Column:
    """SRC-15: the artifact kind, null for what is not supported; a part named like a kind decides."""
    media, ext = media_type(filename, declared), F.lower(F.element_at(F.split(filename, r"\."), -1))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    found = F.when((media == "text/plain") & ext.isin("md", "markdown"), F.lit("document_markdown")).otherwise(F.element_at(kinds, media))
    return F.when(part.isin(*EXPLICIT), part).otherwise(found)


def ingest_files(state: dict[str, DataFrame], files: DataFrame, now) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC-14, SRC-16, AGG-10: (state, one row per file: part, filename, kind, status, reason, artifact_id).

    files has part, filename, declared and content (binary). Each file stands alone: empty and unsupported ones are
    rejected. Texts are decoded and segmented at once; PDFs and images wait for their extractors.
    """
    rows = files.withColumn("kind", classify(F.col("part"), F.col("filename"), F.col("declared"))).withColumn("media_type", media_type(F.col("filename"), F.col("declared")))
    reason = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty file").when(F.col("kind").isNull(), F.concat(F.lit("unsupported media type "), F.col("media_type")))
    rows = rows.withColumn("reason", reason)
    state, kept = store_artifacts(state, rows.where("reason IS NULL").withColumn("source_platform", F.lit("upload")), now)
    fresh = kept.where(~F.col("deduplicated"))
    docs = fresh.where(F.col("kind").startswith("document_")).withColumn("id", X.uuid_of("document", F.col("artifact_id")))
    plain = F.col("kind").isin("document_text", "document_markdown")
    docs = docs.withColumn("extracted_text", F.when(plain, F.make_valid_utf8(F.col("content").cast("string")))).withColumn("extraction_status", F.when(plain, "completed").otherwise("pending")).withColumn("extraction_tool", F.when(plain, "utf8"))
    cut = segments(docs.where(plain).select(F.col("id").alias("document_id"), "extracted_text"), "extracted_text")
    cut = cut.withColumn("id", X.uuid_of("segment", F.col("document_id"), F.col("seq"))).withColumn("content_hash", X.sha256_hex("content"))
    images = fresh.where(F.col("kind").startswith("image_")).withColumn("id", X.uuid_of("image", F.col("artifact_id"))).withColumn("ocr_status", F.lit("pending"))
    for table, new in (("documents", docs), ("document_segments", cut), ("images", images)):
        state = state | {table: schema.append_new(state[table], schema.conform(new, table), ["id"])}
    status = F.when(F.col("deduplicated"), "deduplicated").otherwise("accepted")
    told = kept.select("part", "filename", "kind", status.alias("status"), F.lit(None).cast("string").alias("reason"), "artifact_id")
    return state, told.unionByName(rows.where("reason IS NOT NULL").select("part", "filename", "kind", F.lit("rejected").alias("status"), "reason", F.lit(None).cast("string").alias("artifact_id")))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """SRC-17: (upload, seq, meta struct or null, data binary or null) to one row per upload, or its error.

    The first chunk must be the only one with meta; data must follow.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "meta", "data")))
    rows = chunks.groupBy("upload").agg(ordered.alias("c"))
    metas = F.size(F.filter("c", lambda x: x["meta"].isNotNull()))
    data = F.transform(F.filter("c", lambda x: x["data"].isNotNull()), lambda x: F.hex(x["data"]))
    error = F.when(F.get("c", F.lit(0))["meta"].isNull(), "data before meta").when(metas > 1, "meta sent twice").when(F.size(data) == 0, "no data")
    return rows.select("upload", F.get("c", F.lit(0))["meta"].alias("meta"), F.when(error.isNull(), F.unhex(F.array_join(data, ""))).alias("content"), error.alias("error"))
