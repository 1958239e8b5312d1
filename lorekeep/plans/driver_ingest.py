"""Queries over sources: exports of every platform, logs, files, OCR, versions, and the stored state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import extract, listing, report
from lorekeep.plans import schema, store
from lorekeep.plans.driver import FIRST, NOW, duck, query, read, said, scan_units
from lorekeep.sources import adapters, ingest, media
from lorekeep.streaming import workers

#: Turns of `conversations` as SQL sees them after an adapter: roles renamed, blank texts gone, numbered from 0.
ROLE = "CASE role WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' ELSE role END"
TOLD = f"SELECT conv_id::VARCHAR AS external_id, {ROLE} AS role, trim(text) AS content, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, turn FROM conversations WHERE trim(text) <> ''"
START = 1_700_000_000


def exported(spark, sf_dir, turn: Column, whole) -> DataFrame:
    """One payload per conversation: whole() of the conversation's id and its turns in order, as JSON."""
    c = read(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"])
    rows = c.groupBy("conv_id").agg(turns.alias("turns")).withColumn("id", F.col("conv_id").cast("string"))
    return rows.select("id", F.to_json(whole(F.col("id"), F.col("turns"))).alias("payload"))


def told(platform: str, raw: DataFrame, *more) -> DataFrame:
    got = adapters.normalize(platform, raw)
    return got.select("id", "external_id", "title", F.posexplode("messages").alias("seq", "m")).select(*more, "m.role", "m.content", "seq", F.col("m.created_at").cast("timestamp_ntz").alias("at"))


@query("adapter_claude", f"SELECT external_id, 'Chat ' || external_id AS title, role, content, seq, TIMESTAMP '2024-01-01' + to_seconds(turn) AS at FROM ({TOLD})")
def adapter_claude(spark, sf_dir):
    """SRC-03: text from content blocks for even turns, from the text field for odd ones."""
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    body = F.when(F.col("turn") % 2 == 0, F.array(block, F.struct(F.lit("tool_use").alias("type"), F.lit("no").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    turn = F.struct(F.col("turn").cast("string").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.when(F.col("turn") % 2 == 0, "old").otherwise(F.col("text")).alias("text"), body.alias("content"), stamp.alias("created_at"))
    raw = exported(spark, sf_dir, turn, lambda i, t: F.array(F.struct(i.alias("uuid"), F.concat(F.lit("Chat "), i).alias("name"), t.alias("chat_messages"))))
    return told("claude", raw, "external_id", "title")


@query("adapter_gemini", """
    SELECT conv_id::VARCHAR AS id, 'takeout-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS external_id, unnest(['user', 'assistant']) AS role, unnest([trim(text), 'Turn ' || turn || ' & more']) AS content, unnest([0, 1]) AS seq
    FROM conversations WHERE trim(text) <> ''""")
def adapter_gemini(spark, sf_dir):
    """SRC-04, FN-20: each turn is a record with a prompt and an answer in HTML."""
    answer = F.concat(F.lit("<p>Turn <b>"), F.col("turn").cast("string"), F.lit("</b></p>&amp;<br>more"))
    turn = F.struct(F.concat(F.lit("Prompted "), "text").alias("title"), F.lit("2024-01-01T00:00:00Z").alias("time"), F.struct(answer.alias("htmlValue")).alias("safeHtmlItem"))
    return told("gemini", exported(spark, sf_dir, turn, lambda i, t: t), "id", "external_id").drop("at")


@query("adapter_grok", f"SELECT external_id, role, content, seq, make_timestamp(({START} + turn) * 1000000) AS at FROM ({TOLD})")
def adapter_grok(spark, sf_dir):
    """SRC-05, FN-23: times in epoch milliseconds, as text."""
    turn = F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.col("text").alias("message"), ((F.lit(START) + F.col("turn")) * 1000).cast("string").alias("create_time"))
    raw = exported(spark, sf_dir, turn, lambda i, t: F.struct(F.array(F.struct(i.alias("conversation_id"), i.alias("title"), t.alias("responses"))).alias("conversations")))
    return told("grok", raw, "external_id")


@query("adapter_perplexity", """
    SELECT conv_id::VARCHAR AS external_id, role, content, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INTEGER AS seq FROM
      (SELECT conv_id, turn, unnest([0, 1]) AS k, unnest(['user', 'assistant']) AS role, unnest([trim(text), 'about ' || turn]) AS content FROM conversations) WHERE content <> ''""")
def adapter_perplexity(spark, sf_dir):
    """SRC-06: each turn is an entry with a question and an answer."""
    turn = F.struct(F.col("text").alias("query"), F.concat(F.lit("about "), F.col("turn").cast("string")).alias("answer"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))
    raw = exported(spark, sf_dir, turn, lambda i, t: F.struct(F.array(F.struct(i.alias("id"), i.alias("title"), t.alias("entries"))).alias("threads")))
    return told("perplexity", raw, "external_id").drop("at")


@query("adapter_copilot", f"""
    SELECT conv_id::VARCHAR AS external_id, role, content, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INTEGER AS seq, make_timestamp(({START} + turn) * 1000000) AS at FROM
      (SELECT conv_id, turn, unnest([0, 1]) AS k, unnest(['user', 'assistant']) AS role, unnest([trim(text), 'a' || chr(10) || 'b' || turn]) AS content FROM conversations) WHERE content <> ''""")
def adapter_copilot(spark, sf_dir):
    """SRC-07: a session of requests, each with parts of a response."""
    part = lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("kind"))
    answer = F.array(part(F.lit("a ")), F.struct(F.lit(None).cast("string").alias("value"), F.lit("x").alias("kind")), part(F.concat(F.lit(" b"), F.col("turn").cast("string"))))
    turn = F.struct(F.col("turn").cast("string").alias("requestId"), F.struct(F.col("text").alias("text")).alias("message"), ((F.lit(START) + F.col("turn")) * 1000).alias("timestamp"), answer.alias("response"))
    return told("copilot", exported(spark, sf_dir, turn, lambda i, t: F.struct(i.alias("sessionId"), F.lit("u").alias("requesterUsername"), t.alias("requests"))), "external_id")


@query("adapter_errors", "SELECT * FROM (VALUES ('chatgpt', 'top level must be an array'), ('claude', 'top level must be an array'), ('copilot', 'expected a ''requests'' array'), ('gemini', 'top level must be an array'), ('generic', 'missing ''conversations'' array'), ('grok', 'expected ''conversations'' or a top-level array'), ('perplexity', 'expected ''threads'' or top-level ''entries''')) t(platform, error)")
def adapter_errors(spark, sf_dir):
    """SRC-01: every adapter, given an export of none of them."""
    raw = spark.createDataFrame([('{"odd": 1}',)], "payload string")
    out = None
    for platform in sorted(adapters.ADAPTERS):
        one = adapters.normalize(platform, raw).select(F.lit(platform).alias("platform"), "error")
        out = one if out is None else out.unionByName(one)
    return out


@query("agent_log", f"SELECT 's' || external_id AS session, role, content, seq, seq > 0 AS timed FROM ({TOLD}) WHERE external_id::BIGINT % 7 <> 0")
def agent_log(spark, sf_dir):
    """SRC-09, FN-28, WIN-05: logs of three ways to say a text; of every seventh session a line is no JSON."""
    c = read(spark, sf_dir, "conversations")
    who, t = F.when(F.col("role") == "user", "human").otherwise(F.col("role")), F.col("text")
    time = F.when(F.col("turn") > 0, F.lit("2024-01-01T00:00:00Z"))
    plain = F.to_json(F.struct(who.alias("role"), t.alias("content"), time.alias("timestamp")))
    blocks = F.to_json(F.struct(who.alias("type"), F.array(F.struct(t.alias("text"))).alias("content"), time.alias("timestamp")))
    inner = F.to_json(F.struct(who.alias("sender"), F.struct(t.alias("text")).alias("content"), time.alias("created_at")))
    line = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), "{").when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, blocks).otherwise(inner)
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    lines = c.select(session.alias("session"), F.lit("T").alias("title"), (F.col("turn") + 1).cast("int").alias("line"), line.alias("value"))
    state, _ = ingest.ingest_agent_log(schema.empty_state(spark), lines, "cli", NOW)
    sessions = state["conversations"].select(F.col("id").alias("conversation_id"), F.col("external_id").alias("session"))
    return state["messages"].join(sessions, "conversation_id").select("session", "role", "content", "seq", F.col("created_at").isNotNull().alias("timed"))


@query("agent_log_errors", "SELECT DISTINCT 's' || conv_id AS session, 'invalid JSONL at line 1' AS error FROM conversations WHERE conv_id % 7 = 0")
def agent_log_errors(spark, sf_dir):
    """SRC-09: logs with a broken line say which one it is."""
    c = read(spark, sf_dir, "conversations")
    line = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), "{").otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    lines = c.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.lit("T").alias("title"), (F.col("turn") + 1).cast("int").alias("line"), line.alias("value"))
    return adapters.agent_log(lines).where("error IS NOT NULL").select("session", "error")


@query("chat_export_counts", """
    WITH p AS (SELECT conv_id, string_agg(text, chr(1) ORDER BY turn) AS t, count(*) FILTER (trim(text) <> '') AS n FROM conversations GROUP BY 1)
    SELECT unnest([1, 2]) AS run, unnest([count(*), 0]) AS conversations, unnest([sum(n), 0])::BIGINT AS messages, unnest([0, count(*)])::BIGINT AS deduplicated, 3::BIGINT AS rejected FROM p""")
def chat_export_counts(spark, sf_dir):
    """SRC-10, SRC-12, AGG-10: exports of every conversation and three bad ones, ingested twice."""
    turn = F.struct("role", F.col("text").alias("content"))
    raw = exported(spark, sf_dir, turn, lambda i, t: F.struct(F.array(F.struct(i.alias("id"), t.alias("messages"))).alias("conversations"))).withColumnRenamed("id", "filename")
    raw = raw.unionByName(spark.createDataFrame([("b1", "{"), ("b2", "[]"), ("b3", '{"conversations": 1}')], "filename string, payload string"))
    state, first = ingest.chat_export(schema.empty_state(spark), raw, "generic", NOW)
    _, second = ingest.chat_export(state, raw, "generic", NOW)
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


FILES = "SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'exe' ELSE 'txt' END AS ext, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS body FROM documents"


@query("file_ingest", f"""
    WITH f AS ({FILES}), ok AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY 'f' || lpad(doc_id::VARCHAR, 9, '0')) AS pos FROM f WHERE body <> '' AND ext <> 'exe')
    SELECT 'f' || lpad(f.doc_id::VARCHAR, 9, '0') || '.' || f.ext AS filename, CASE WHEN f.body = '' THEN 'rejected' WHEN f.ext = 'exe' THEN 'rejected' WHEN ok.pos = 1 THEN 'accepted' ELSE 'deduplicated' END AS status,
      CASE WHEN f.body = '' THEN 'empty file' WHEN f.ext = 'exe' THEN 'unsupported media type application/octet-stream' END AS reason FROM f LEFT JOIN ok USING (doc_id)""")
def file_ingest(spark, sf_dir):
    """SRC-14..16, AGG-10: every document as a file; some are empty, some of an unsupported kind, some copies."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("md", "txt", "exe", "txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("."), ext)
    body = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text"))
    files = read(spark, sf_dir, "documents").select(F.lit("file").alias("part"), name.alias("filename"), F.lit(None).cast("string").alias("declared"), F.encode(body, "UTF-8").alias("content"))
    _, got = ingest.ingest_files(schema.empty_state(spark), files, NOW)
    return got.select("filename", "status", "reason")


BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("segment_texts", rf"""
    SELECT doc_id, sha256(regexp_replace(text, '{BLANK}', '', 'g')) AS kept, true AS fits, strlen(text) <= 2000 AS small, CASE WHEN strlen(text) <= 2000 THEN 1 END::BIGINT AS parts
    FROM documents WHERE regexp_replace(text, '{BLANK}', '', 'g') <> ''""")
def segment_texts(spark, sf_dir):
    """EXT-01, FN-26 over all whole texts: segments hold all of a text but blanks, within the limit; a small text is one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = extract.segments(docs).groupBy("doc_id", "text").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["content"]), "")
    small = F.octet_length("text") <= extract.MAX_SEGMENT_BYTES
    return got.select("doc_id", F.sha2(F.regexp_replace(whole, BLANK, ""), 256).alias("kept"), F.forall("s", lambda x: F.octet_length(x["content"]) <= extract.MAX_SEGMENT_BYTES).alias("fits"), small.alias("small"), F.when(small, F.size("s")).cast("bigint").alias("parts"))


@query("upload_chunks", """
    SELECT conv_id AS upload, CASE WHEN conv_id % 5 = 0 THEN 'data before meta' WHEN conv_id % 5 = 1 THEN 'meta sent twice' END AS error, CASE WHEN conv_id % 5 > 1 THEN sha256(string_agg(text, '' ORDER BY turn)) END AS content_hash FROM conversations GROUP BY conv_id""")
def upload_chunks(spark, sf_dir):
    """SRC-17, SRC-27: uploads in chunks, of which some break the order."""
    c = read(spark, sf_dir, "conversations")
    data = c.select(F.col("conv_id").alias("upload"), (F.col("turn") + 1).cast("int").alias("seq"), F.lit(None).cast("string").alias("meta"), F.encode("text", "UTF-8").alias("data"))
    ids = c.select(F.col("conv_id").alias("upload")).distinct()
    meta = lambda where, seq: ids.where(where).select("upload", F.lit(seq).alias("seq"), F.lit("m").alias("meta"), F.lit(None).cast("binary").alias("data"))
    got = ingest.joined_chunks(data.unionByName(meta("upload % 5 > 0", 0)).unionByName(meta("upload % 5 = 1", 1_000_000)))
    return got.select("upload", "error", F.sha2("content", 256).alias("content_hash"))


@query("ocr_lines", r"""
    WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> ''), 1) AS n FROM conversations WHERE conv_id % 2 = 0),
    l AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY n) AS line, sum(50 + n % 50) AS conf, count(*) AS k FROM w GROUP BY 1, 2)
    SELECT conv_id::VARCHAR AS image_id, sha256(string_agg(line, chr(10) ORDER BY turn)) AS text_hash, round(sum(conf) / sum(k) / 100, 6) AS ocr_confidence FROM l GROUP BY 1""")
def ocr_lines(spark, sf_dir):
    """SRC-20, AGG-09: words of a table of OCR results to lines and their mean confidence."""
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")
    w = read(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id", "turn", F.posexplode(words).alias("n", "word"))
    cells = [F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.col("turn").cast("string"), *[F.lit("0")] * 5, (50 + (F.col("n") + 1) % 50).cast("string"), F.col("word")]
    lines = w.select(F.col("conv_id").cast("string").alias("image_id"), (F.col("turn") * 1_000_000 + F.col("n")).cast("int").alias("n"), F.concat_ws("\t", *cells).alias("value"))
    got = media.parse_ocr_tsv(lines)
    return got.select("image_id", F.sha2("ocr_text", 256).alias("text_hash"), "ocr_confidence")


@query("pdf_and_image_queue", """
    SELECT unnest(['pdf', 'image']) AS queue, unnest([list_count(list(1) FILTER (s_suppkey % 3 > 0)), list_count(list(1) FILTER (s_suppkey % 3 > 0))])::BIGINT AS completed, unnest([list_count(list(1) FILTER (s_suppkey % 3 = 0)), list_count(list(1) FILTER (s_suppkey % 3 = 0))])::BIGINT AS failed FROM supplier""")
def pdf_and_image_queue(spark, sf_dir):
    """SRC-18, SRC-19, SRC-21..23: pending PDFs and images through extractors that fail on every third."""
    s = read(spark, sf_dir, "supplier")
    body = lambda kind: F.encode(F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.lit("bad ")).otherwise(F.lit("good ")), F.lit(kind), "s_name"), "UTF-8")
    one = lambda ext: s.select(F.lit("file").alias("part"), F.concat("s_name", F.lit(f".{ext}")).alias("filename"), F.lit(None).cast("string").alias("declared"), body(ext).alias("content"))
    state, _ = ingest.ingest_files(schema.empty_state(spark), one("pdf").unionByName(one("png")), NOW)

    def pdf(data: bytes) -> dict:
        if data.startswith(b"bad"):
            raise ValueError("no PDF")
        return {"text": "We decided to use\nSpark for the reports. " * 3, "pages": 1}

    def image(data: bytes) -> dict:
        if data.startswith(b"bad"):
            raise ValueError("no image")
        return {"width": 3, "height": 2, "taken_at": "2024:01:02 03:04:05", "ocr_tsv": None}

    state = media.process_images(media.process_pdfs(state, pdf), image)
    count = lambda name, df, status: df.agg(F.lit(name).alias("queue"), F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"))
    return count("pdf", state["documents"], "extraction_status").unionByName(count("image", state["images"], "ocr_status"))


@query("artifact_versions", "SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 50 + 1)::INTEGER AS version FROM orders")
def artifact_versions(spark, sf_dir):
    """MUT-04: chains of 50 versions, each superseding the one before."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 50 > 0, (F.col("o_orderkey") - 1).cast("string")).alias("supersedes_artifact_id"))
    return media.artifact_versions(o)


@query("store_versions", """
    SELECT * FROM (VALUES (1, (SELECT count(*) FROM customer), 1, 1), (2, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), 2, 1), (3, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), 2, 1)) t(version, units, unit_folders, edge_folders)""")
def store_versions(spark, sf_dir):
    """MUT-06: a version that only grew stores only what is new; one without changes stores nothing."""
    folder = f"{store.checkpoint_folder(spark)}/lorekeep/store-{uuid.uuid4().hex}"
    units, edges = scan_units(spark, sf_dir, "exclusive")
    more = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    out = []
    state = schema.empty_state(spark) | {"atomic_units": units, "relationships": edges}
    for version in (1, 2, 3):
        store.save(state, folder)
        state = store.load(spark, folder)
        out.append((version, state["atomic_units"].count(), len(state.stored["atomic_units"][1]), len(state.stored["relationships"][1])))
        if version == 1:
            state = state | {"atomic_units": schema.grown(state["atomic_units"], schema.conform(more, "atomic_units"))}
    return spark.createDataFrame(out, "version int, units long, unit_folders int, edge_folders int")


@query("stream_state", f"""
    WITH s AS (SELECT {duck(FIRST)} AS t FROM part), u AS (SELECT regexp_replace(trim(lower(t)), '[.]+$', '') AS n, min(t) AS t, count(*) AS sightings FROM s GROUP BY 1)
    SELECT sha256(n) AS statement_hash, sightings, (t NOT LIKE 'I never%')::INTEGER AS edges, true AS as_batch FROM u""")
def stream_state(spark, sf_dir):
    """STR-01, STR-05: extraction as a stream over four files in batches of one writes units, provenance, entities and
    edges into the stored state, as one batch over all of them would."""
    base = f"{store.checkpoint_folder(spark)}/lorekeep/stream-{uuid.uuid4().hex}"
    chunks = said(spark, sf_dir, "part", "p_partkey", FIRST)
    chunks.repartitionByRange(4, "source_time").sortWithinPartitions("source_time").write.parquet(f"{base}/in")
    store.save(schema.empty_state(spark), f"{base}/state")
    workers.run_extraction(spark, f"{base}/in", f"{base}/state", f"{base}/cursor", now=NOW, files_per_trigger=1).awaitTermination()
    state = store.load(spark, f"{base}/state")
    whole, _ = extract.persist_units(schema.empty_state(spark), extract.extract_units(chunks), NOW)
    same = None
    for table in ("entities", "atomic_unit_provenance", "relationships"):
        one = state[table].select("id").exceptAll(whole[table].select("id")).unionAll(whole[table].select("id").exceptAll(state[table].select("id")))
        same = one if same is None else same.unionAll(one)
    odd = same.count()
    p = state["atomic_unit_provenance"].groupBy(F.col("atomic_unit_id").alias("id")).agg(F.count("*").alias("sightings"))
    e = state["relationships"].groupBy(F.col("atomic_unit_id").alias("id")).agg(F.count("*").cast("int").alias("edges"))
    return state["atomic_units"].select("id", "statement_hash").join(p, "id").join(e, "id", "left").select("statement_hash", "sightings", F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(odd == 0).alias("as_batch"))


@query("latency_histogram", """
    WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 'Infinity'::DOUBLE])::DOUBLE AS le)
    SELECT event_type, CASE WHEN le = 'Infinity' THEN '+Inf' ELSE le::VARCHAR END AS le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END)::BIGINT AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    """SRC-28, AGG-14: cumulative bucket counts, as a metrics endpoint shows them."""
    return report.histogram(read(spark, sf_dir, "events"), "value", ["event_type"], (1.0, 5.0, 10.0, 50.0, 100.0))


@query("json_rows", """SELECT s_suppkey AS id, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS json FROM supplier""")
def json_rows(spark, sf_dir):
    """FLT-13."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return listing.as_json(s).select(F.col("s_suppkey").alias("id"), "json")


@query("fn_times", f"""
    SELECT o_orderkey, make_timestamp((o_orderkey * 1000 + {START}) * 1000000 + 500000) AS from_seconds, make_timestamp((o_orderkey * 1000 + {START}) * 1000000) AS from_millis, o_orderdate AS parsed, NULL::TIMESTAMP AS not_parsed FROM orders""")
def fn_times(spark, sf_dir):
    """FN-23, FN-24."""
    o, s = read(spark, sf_dir, "orders"), F.col("o_orderkey") * 1000 + START
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    naive = lambda c: c.cast("timestamp_ntz")
    return o.select("o_orderkey", naive(X.from_epoch_seconds(s + 0.5)).alias("from_seconds"), naive(X.from_epoch_millis(s * 1000)).alias("from_millis"), naive(X.rfc3339(F.concat(text, F.lit("Z")))).alias("parsed"), naive(X.rfc3339(text)).alias("not_parsed"))


@query("fn_texts", r"""
    SELECT p_partkey, CASE WHEN strlen(p_name) <= 12 THEN p_name ELSE p_name[1:12] || '…' END AS cut, p_name AS heading, NULL::VARCHAR AS no_heading, p_name || ' ' || p_type || chr(10) || chr(10) || p_brand AS unwrapped FROM part""")
def fn_texts(spark, sf_dir):
    """FN-21, FN-25, FN-27."""
    p = read(spark, sf_dir, "part")
    wrapped = F.concat("p_name", F.lit("  \r\n \n"[:4]), "p_type", F.lit("\n\n"), "p_brand", F.lit("\n"))
    return p.select("p_partkey", X.truncate_bytes("p_name", 12).alias("cut"), X.heading(F.concat(F.lit("  ## "), "p_name", F.lit(" "))).alias("heading"), X.heading(F.concat(F.lit("####### "), "p_name")).alias("no_heading"), X.unwrap_hard_lines(wrapped).alias("unwrapped"))


@query("fn_windows", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderdate + to_days(30) <= TIMESTAMP '1996-01-01' OR TIMESTAMP '1997-01-01' <= o_orderdate END AS disjoint FROM orders""")
def fn_windows(spark, sf_dir):
    """FN-12: a month from the order against a year; every third month has no known start."""
    start = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    year = [F.lit(f"{y}-01-01").cast("timestamp") for y in (1996, 1997)]
    return read(spark, sf_dir, "orders").select("o_orderkey", X.windows_disjoint(start, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), *year).alias("disjoint"))
