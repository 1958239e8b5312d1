"""The engine's operators as queries over the star-schema, text and vector tables, each with the SQL it must equal.

The tables hold no sentence that a rule would match, so statements are built from their columns by the same text on
both sides. Every query works on all rows of the tables it names; limits are those of the feature (a page, a top-k).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import entities as E
from lorekeep.operators import extract, graph, listing, report, review, scan, search
from lorekeep.plans import schema, store
from lorekeep.sources import adapters, bundle, ingest
from lorekeep.streaming import workers

NOW = dt.datetime(2024, 1, 1)
QUERIES: dict = {}
SQL: dict[str, str] = {}

# Statements, as text that Spark SQL and DuckDB both read.
NUMERIC = "concat('My ', c_name, ' budget is $', cast(cast(floor(abs(c_acctbal)) AS bigint) AS {s}), ' per month.')"
FIRST = "concat('I ', CASE p_partkey % 6 WHEN 0 THEN 'prefer' WHEN 1 THEN 'use' WHEN 2 THEN 'have' WHEN 3 THEN 'work at' WHEN 4 THEN 'never use' ELSE 'live in' END, ' the ', p_name, '.')"
DECISION = "concat('We decided to use ', p_name, ' from ', p_brand, '.')"
TEMPORAL = "concat('On ', {day}, ', order ', cast(o_orderkey AS {s}), ' came from customer ', cast(o_custkey AS {s}), '.')"
DEFINITION = "concat(p_brand, ' item ', cast(p_partkey AS {s}), ' means ', p_type, '.')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that an ingest would have left: stored by the first query of the application that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def said(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    """Chunks with one synthesized statement per row, dealt to all cores as files of an ingest would be."""
    rows = read(spark, sf_dir, table).repartition(spark.sparkContext.defaultParallelism)
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    return rows.select(F.lit("message").alias("anchor"), F.col(key).cast("string").alias("anchor_id"), F.lit("a").alias("artifact_id"), F.expr(text.format(s="string", day=day)).alias("text"), F.lit("user").alias("role"), F.timestamp_seconds(F.col(key)).alias("source_time"), F.lit(None).cast("double").alias("ocr_confidence"))


def duck(text: str) -> str:
    return text.format(s="varchar", day="strftime(o_orderdate, '%Y-%m-%d')")


@query("artifact_dedup", """
    SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies, max(strlen(text)) AS byte_size FROM documents GROUP BY 1""")
def artifact_dedup(spark, sf_dir):
    """SRC-11: contents by hash."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("bigint").alias("byte_size"))


@query("artifact_store", """
    SELECT sha256(text) AS content_hash, strlen(min(text)) AS byte_size, 1 AS version FROM documents GROUP BY 1""")
def artifact_store(spark, sf_dir):
    """SRC-11, JOIN-16 through the store itself: storing twice stores once."""
    docs = read(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("content"), F.col("doc_id").cast("string").alias("filename"), F.lit("document_text").alias("kind"))
    state, _ = ingest.store_artifacts(schema.empty_state(spark), docs, NOW)
    state["artifacts"] = store.checkpointed(state["artifacts"])
    state, _ = ingest.store_artifacts(state, docs, NOW)
    return state["artifacts"].select("content_hash", F.col("byte_size").cast("bigint").alias("byte_size"), "version")


@query("artifact_list_filtered", """
    SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 50""")
def artifact_list_filtered(spark, sf_dir):
    """FLT-01, SRT-01."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return listing.page(listing._equal(docs, lang="en", source="src1", n_chars=None), [F.desc("n_chars"), "doc_id"], None, None)


@query("conversation_detail", """
    SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS user_turns, min(turn) AS first_turn, max(turn) AS last_turn,
      sha256(string_agg(role || '|' || trim(text), chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id""")
def conversation_detail(spark, sf_dir):
    """AGG-15, SRT-09: one row per conversation, with its turns in order."""
    c = read(spark, sf_dir, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("|", X.normalize_role("role"), F.trim("text")).alias("t")))), lambda x: x["t"])
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sha2(F.array_join(lines, "\n"), 256).alias("transcript"))


@query("adapter_generic", """
    SELECT conv_id::VARCHAR AS external_id, role, trim(text) AS content, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq FROM conversations WHERE trim(text) <> ''""")
def adapter_generic(spark, sf_dir):
    """SRC-08, SRC-10, SRC-13: conversations as JSON exports, normalised and stored as messages."""
    c = read(spark, sf_dir, "conversations")
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    one = c.groupBy("conv_id").agg(msgs.alias("messages")).select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), "messages")).alias("conversations"))).alias("payload"))
    got = adapters.normalize("generic", one)
    return got.select("external_id", F.posexplode("messages").alias("seq", "m")).select("external_id", "m.role", "m.content", "seq")


@query("adapter_chatgpt", """
    SELECT conv_id::VARCHAR AS external_id, role, trim(text) AS content, turn::VARCHAR AS message_id, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent FROM conversations WHERE trim(text) <> ''""")
def adapter_chatgpt(spark, sf_dir):
    """SRC-02: a branch up from current_node, through a mapping in which each turn's parent is the one before; a
    regenerated sibling of each first turn is off the branch."""
    c = read(spark, sf_dir, "conversations")
    t = F.col("turn").cast("string")
    body = lambda text: F.struct(t.alias("id"), F.struct("role").alias("author"), F.struct(F.array(text).alias("parts")).alias("content"))
    node = F.struct(t.alias("key"), F.struct(F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), body(F.col("text")).alias("message")).alias("value"))
    side = F.when(F.col("turn") == 0, F.struct(F.lit("again").alias("key"), F.struct(F.lit(None).cast("string").alias("parent"), body(F.lit("regenerated")).alias("message")).alias("value")))
    nodes = F.map_from_entries(F.concat(F.collect_list(node), F.collect_list(side)))
    one = c.groupBy("conv_id").agg(nodes.alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    raw = one.select(F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), "mapping", "current_node"))).alias("payload"))
    got = adapters.normalize("chatgpt", raw).select("external_id", F.explode("messages").alias("m"))
    return got.select("external_id", "m.role", "m.content", F.col("m.external_id").alias("message_id"), F.col("m.parent_external_id").alias("parent"))


def _unit_sql(table: str, key: str, statement: str, fields: str, where: str = "") -> str:
    return f"WITH s AS (SELECT {key}::VARCHAR AS anchor_id, {duck(statement)} AS t FROM {table}) SELECT anchor_id, {fields}, 0 AS char_start, strlen(t)::INTEGER AS char_end, regexp_replace(t, '[.]+$', '') AS statement FROM s {where}"


def _units(spark, sf_dir, table, key, statement, *fields):
    got = extract.extract_units(said(spark, sf_dir, table, key, statement))
    return got.select("anchor_id", *fields, "char_start", "char_end", "statement")


@query("unit_numeric", _unit_sql("customer", "c_custkey", NUMERIC, r"regexp_extract(t, '(?i)^\s*(?:my|our|the)?\s*(.{2,60}?)\s+(?:is|costs?|takes?|weighs?)\s+', 1) AS subject, regexp_extract(t, 'is (\$[0-9]+)', 1) AS value, 'per month' AS unit"))
def unit_numeric(spark, sf_dir):
    """EXT-02, EXT-07, FN-05."""
    return _units(spark, sf_dir, "customer", "c_custkey", NUMERIC, "subject", "value", "unit")


@query("unit_first_person", _unit_sql("part", "p_partkey", FIRST, r"CASE WHEN t LIKE 'I prefer%' THEN 'preference' ELSE 'fact' END AS kind, CASE WHEN t LIKE 'I never%' THEN NULL ELSE regexp_extract(t, '^I (?:prefer|use|have|work at|live in) the (.*)[.]$', 1) END AS object, CASE WHEN t LIKE 'I never%' THEN NULL WHEN t LIKE 'I prefer%' THEN 'prefers' WHEN t LIKE 'I use%' THEN 'uses' WHEN t LIKE 'I have%' THEN 'has' WHEN t LIKE 'I work%' THEN 'works_at' ELSE 'lives_in' END AS relation, t LIKE 'I never%' AS negated"))
def unit_first_person(spark, sf_dir):
    """EXT-05."""
    return _units(spark, sf_dir, "part", "p_partkey", FIRST, "kind", "object", "relation", "negated")


@query("unit_decision", _unit_sql("part", "p_partkey", DECISION, r"'decision' AS kind, 'Me' AS subject, regexp_extract(t, '^We decided to use (.*)[.]$', 1) AS object"))
def unit_decision(spark, sf_dir):
    """EXT-03."""
    return _units(spark, sf_dir, "part", "p_partkey", DECISION, "kind", "subject", "object")


@query("unit_temporal", _unit_sql("orders", "o_orderkey", TEMPORAL, r"'event' AS kind, substr(t, 4, 10)::TIMESTAMP AS event_time"))
def unit_temporal(spark, sf_dir):
    """EXT-04."""
    return _units(spark, sf_dir, "orders", "o_orderkey", TEMPORAL, "kind", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("unit_definition", _unit_sql("part", "p_partkey", DEFINITION, r"split_part(t, ' means ', 1) AS subject, regexp_replace(split_part(t, ' means ', 2), '[.]$', '') AS object, 'defined_as' AS relation"))
def unit_definition(spark, sf_dir):
    """EXT-06."""
    return _units(spark, sf_dir, "part", "p_partkey", DEFINITION, "subject", "object", "relation")


@query("unit_dedup_provenance", f"""
    WITH s AS (SELECT p_partkey, {duck(FIRST)} AS t FROM part) SELECT sha256(regexp_replace(trim(lower(t)), '[.]+$', '')) AS statement_hash, count(*) AS sightings FROM s GROUP BY 1""")
def unit_dedup_provenance(spark, sf_dir):
    """EXT-12, EXT-13, SET-06: a statement is one unit; each sighting is provenance."""
    state, _ = extract.persist_units(schema.empty_state(spark), extract.extract_units(said(spark, sf_dir, "part", "p_partkey", FIRST)), NOW)
    p = state["atomic_unit_provenance"].groupBy(F.col("atomic_unit_id").alias("id")).agg(F.count("*").alias("sightings"))
    return state["atomic_units"].select("id", "statement_hash").join(p, "id").select("statement_hash", "sightings")


@query("unit_edges", f"""
    WITH s AS (SELECT p_partkey, {duck(FIRST)} AS t FROM part), o AS (SELECT DISTINCT lower(t) AS k, lower(regexp_extract(t, '^I (?:prefer|use|have|work at|live in) the (.*)[.]$', 1)) AS name,
      CASE WHEN t LIKE 'I prefer%' THEN 'prefers' WHEN t LIKE 'I use%' THEN 'uses' WHEN t LIKE 'I have%' THEN 'has' WHEN t LIKE 'I work%' THEN 'works_at' ELSE 'lives_in' END AS relation_type FROM s WHERE t NOT LIKE 'I never%')
    SELECT 'me' AS source, name AS target, relation_type, count(*) AS edges FROM o GROUP BY 2, 3""")
def unit_edges(spark, sf_dir):
    """ENT-01, EXT-14: subjects and objects become entities, first assertions edges between them."""
    state, _ = extract.persist_units(schema.empty_state(spark), extract.extract_units(said(spark, sf_dir, "part", "p_partkey", FIRST)), NOW)
    name = lambda c, out: state["entities"].select(F.col("id").alias(c), F.lower("name").alias(out))
    return state["relationships"].join(name("source_entity_id", "source"), "source_entity_id").join(name("target_entity_id", "target"), "target_entity_id").groupBy("source", "target", "relation_type").agg(F.count("*").alias("edges"))


@query("entity_resolve", """
    WITH e AS (SELECT lower(s_name) AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1), n AS (SELECT s_suppkey AS key, upper(s_name) AS name FROM supplier UNION ALL SELECT s_suppkey, 'alias of ' || s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part)
    SELECT n.name, coalesce('s' || coalesce(e.id, a.id)::VARCHAR, 'new') AS entity FROM (SELECT DISTINCT name FROM n) n LEFT JOIN e ON lower(n.name) = e.k LEFT JOIN e a ON lower(n.name) = 'alias of ' || a.k""")
def entity_resolve(spark, sf_dir):
    """ENT-01, SET-03, JOIN-21: names by any case, by alias, or new."""
    s = read(spark, sf_dir, "supplier")
    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    state = schema.empty_state(spark) | {"entities": schema.conform(s.select(sid.alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind")), "entities"), "entity_aliases": s.select(F.concat(F.lit("a"), sid).alias("id"), sid.alias("entity_id"), F.concat(F.lit("Alias of "), "s_name").alias("alias"))}
    names = s.select(F.upper("s_name").alias("name")).union(s.select(F.concat(F.lit("alias of "), "s_name"))).union(read(spark, sf_dir, "part").select("p_name"))
    _, found = extract.resolve_names(state, names, NOW)
    return found.select("name", F.when(F.col("entity_id").rlike("^s[0-9]+$"), F.col("entity_id")).otherwise("new").alias("entity"))


EDGES_SQL = """e AS (SELECT DISTINCT 'p' || l_partkey::VARCHAR || '-s' || l_suppkey::VARCHAR AS id, 'p' || l_partkey::VARCHAR AS s, 's' || l_suppkey::VARCHAR AS t, (l_partkey + l_suppkey) % 10 <> 0 AS live FROM lineitem),
    und AS (SELECT s AS node, t AS other FROM e WHERE live UNION SELECT t, s FROM e WHERE live)"""


def edges_of(spark, sf_dir) -> DataFrame:
    """Part-supplier edges of lineitem, stored; those whose keys sum to a multiple of ten are superseded."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    pair = items.repartition(max(spark.sparkContext.defaultParallelism, -(-items.count() // graph.SORTED)), "l_partkey", "l_suppkey").distinct()
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    status = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 10 == 0, "superseded").otherwise("active")
    rows = pair.select(F.concat_ws("-", p, s).alias("id"), p.alias("source_entity_id"), s.alias("target_entity_id"), F.lit("supplied_by").alias("relation_type"), F.lit(1.0).alias("confidence"), status.alias("status"), F.lit(None).cast("string").alias("atomic_unit_id"))
    return stored(spark, sf_dir, "edges", lambda: store.checkpointed(rows))


def adjacency_of(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "adjacency", lambda: graph.adjacency(edges_of(spark, sf_dir)))


def _graph_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, walk(node, lvl) AS (SELECT 's1', 0 UNION SELECT u.other, w.lvl + 1 FROM walk w JOIN und u ON u.node = w.node WHERE w.lvl < {depth - 1}),
      seen AS (SELECT node, min(lvl) AS lvl FROM walk GROUP BY 1), inc AS (SELECT id, min(lvl) + 1 AS depth FROM (SELECT e.id, seen.lvl FROM e JOIN seen ON seen.node = e.s WHERE live UNION ALL SELECT e.id, seen.lvl FROM e JOIN seen ON seen.node = e.t WHERE live) GROUP BY 1)
      SELECT inc.depth::INTEGER AS depth, inc.id AS relationship_id, e.s AS source_entity_id, e.t AS target_entity_id, false AS truncated FROM inc JOIN e USING (id)"""


def _graph(depth: int):
    def run(spark, sf_dir):
        found = graph.neighborhood(adjacency_of(spark, sf_dir), "s1", depth, max_nodes=0)
        return found.select("depth", "relationship_id", "source_entity_id", "target_entity_id", "truncated")

    run.__doc__ = f"GRAPH-01, JOIN-11, JOIN-13, WIN-03 at depth {depth}."
    return run


for _d in (1, 2, 3):
    query(f"graph_depth{_d}", _graph_sql(_d))(_graph(_d))


@query("graph_capped", f"""WITH {EDGES_SQL}, l1 AS (SELECT other AS node, row_number() OVER (ORDER BY other) AS pos FROM (SELECT DISTINCT other FROM und WHERE node = 's1' AND other <> 's1')),
    seen AS (SELECT 's1' AS node, 0 AS lvl UNION ALL SELECT node, 1 FROM l1 WHERE pos <= 29), inc AS (SELECT id, min(lvl) + 1 AS depth FROM (SELECT e.id, seen.lvl FROM e JOIN seen ON seen.node = e.s WHERE live UNION ALL SELECT e.id, seen.lvl FROM e JOIN seen ON seen.node = e.t WHERE live) GROUP BY 1)
    SELECT depth::INTEGER AS depth, id AS relationship_id, (SELECT count(*) FROM l1) > 29 OR (SELECT count(*) FROM inc) > 100 AS truncated FROM inc ORDER BY depth, id LIMIT 100""")
def graph_capped(spark, sf_dir):
    """GRAPH-01 with a budget of 30 nodes and 100 edges: WIN-01, WIN-02, SRT-05, SRT-11."""
    return graph.neighborhood(adjacency_of(spark, sf_dir), "s1", 2, 30, 100).select("depth", "relationship_id", "truncated")


@query("graph_batch", f"""WITH {EDGES_SQL}, r AS (SELECT DISTINCT t AS root FROM e), l1 AS (SELECT r.root, u.other AS node FROM r JOIN und u ON u.node = r.root), seen AS (SELECT root, root AS node, 0 AS lvl FROM r UNION ALL SELECT root, node, 1 FROM l1),
    inc AS (SELECT root, id, min(lvl) + 1 AS depth FROM (SELECT seen.root, e.id, seen.lvl FROM e JOIN seen ON seen.node = e.s WHERE live UNION ALL SELECT seen.root, e.id, seen.lvl FROM e JOIN seen ON seen.node = e.t WHERE live) GROUP BY 1, 2)
    SELECT root, count(*) AS edges, sum(CASE WHEN depth = 1 THEN 1 ELSE 0 END)::BIGINT AS near FROM inc GROUP BY 1""")
def graph_batch(spark, sf_dir):
    """GRAPH-01 for every supplier at once, at depth 2."""
    roots = edges_of(spark, sf_dir).select(F.col("target_entity_id").alias("root")).distinct()
    found = graph.neighborhoods(adjacency_of(spark, sf_dir), roots, 2, max_nodes=0)
    return found.groupBy("root").agg(F.count("*").alias("edges"), F.count_if(F.col("depth") == 1).alias("near"))


@query("degree_stats", f"""WITH {EDGES_SQL}, n AS (SELECT 's' || s_suppkey::VARCHAR AS id FROM supplier UNION ALL SELECT 'p' || p_partkey::VARCHAR FROM part), d AS (SELECT n.id, count(x.node) AS degree FROM n LEFT JOIN (SELECT s AS node FROM e UNION ALL SELECT t FROM e) x ON x.node = n.id GROUP BY 1)
    SELECT max(degree) AS max_degree, quantile_disc(degree, 0.9) AS p90_degree, quantile_disc(degree, 0.5) AS p50_degree, round(max(degree) / greatest(quantile_disc(degree, 0.5), 1), 6) AS skew FROM d""")
def degree_stats(spark, sf_dir):
    """AGG-03, AGG-04."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return report.degree_stats(s.unionAll(p), edges_of(spark, sf_dir))


# Units for the scan: customers of a segment and a number share a budget, with values that differ.
STOPS = ", ".join(f"'{w}'" for w in (*X.STOPWORDS, *X.NEGATORS, "longer", "anymore"))
UNIT_TEXT = {
    "numeric": "concat('The ', lower(c_mktsegment), ' budget ', cast(c_custkey % 40 AS {s}), ' is $', cast(cast(floor(abs(c_acctbal)) AS bigint) AS {s}))",
    "negation": "concat('Plan ', cast(c_custkey % 297 AS {s}), ' does ', CASE WHEN c_custkey % 7 = 0 THEN 'not ' ELSE '' END, 'cover the ', lower(c_mktsegment), ' segment')",
    "antonym": "concat('Rule ', cast(c_custkey % 297 AS {s}), ' is ', CASE WHEN c_custkey % 5 = 0 THEN 'public' ELSE 'private' END, ' for the ', lower(c_mktsegment), ' segment')",
    "exclusive": "concat('Owner ', cast(c_custkey % 297 AS {s}), ' lives in nation ', cast(c_nationkey AS {s}), ' today')",
}
SUBJECT = {"numeric": "concat(c_mktsegment, cast(c_custkey % 40 AS {s}))", "negation": "concat('plan', cast(c_custkey % 297 AS {s}))", "antonym": "concat('rule', cast(c_custkey % 297 AS {s}))", "exclusive": "concat('owner', cast(c_custkey % 297 AS {s}))"}


def scan_units(spark, sf_dir, rule: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    attrs = F.struct(F.lit("numeric" if rule == "numeric" else "definition").alias("pattern"), F.concat(F.lit("$"), F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")).alias("value"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("verb"), F.lit(False).alias("negated"), F.lit(None).cast("string").alias("date"))
    uid = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rows = c.select(uid.alias("id"), F.lit("claim").alias("kind"), F.expr(UNIT_TEXT[rule].format(s="string")).alias("statement"), F.expr(SUBJECT[rule].format(s="string")).alias("subject_entity_id"), F.lit("active").alias("status"), attrs.alias("attrs"), F.timestamp_seconds("c_custkey").alias("created_at"))
    edges = c.select(uid.alias("id"), F.expr(SUBJECT[rule].format(s="string")).alias("source_entity_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_entity_id"), F.lit("lives_in").alias("relation_type"), uid.alias("atomic_unit_id"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"))
    return schema.conform(rows, "atomic_units"), schema.conform(edges if rule == "exclusive" else edges.limit(0), "relationships")


def _scan_sql(rule: str, threshold: float) -> str:
    text, subject = UNIT_TEXT[rule].format(s="varchar"), SUBJECT[rule].format(s="varchar")
    tests = {
        "numeric": ("0.80", "greatest(a.v, b.v) > 0 AND abs(a.v - b.v) / greatest(a.v, b.v) > 0.10"),
        "negation": ("0.75", "(a.t LIKE '% not %') <> (b.t LIKE '% not %') AND sim >= 0.5"),
        "antonym": ("0.60", "(a.t LIKE '%public%') <> (b.t LIKE '%public%') AND sim >= 0.3"),
        "exclusive": ("0.70", "a.n <> b.n"),
    }
    base, test = tests[rule]
    return f"""WITH u AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, {text} AS t, {subject} AS s, floor(abs(c_acctbal)) AS v, c_nationkey AS n, c_custkey AS k FROM customer),
      w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9$.]+'), lambda x: x <> '' AND x NOT IN ({STOPS}))) AS ct FROM u),
      p AS (SELECT a, b, row_number() OVER (PARTITION BY a.id ORDER BY b.k DESC, b.id) AS pos FROM w a JOIN w b ON a.s = b.s AND a.id <> b.id),
      m AS (SELECT *, len(list_intersect(a.ct, b.ct)) / len(list_distinct(list_concat(a.ct, b.ct))) AS sim FROM p WHERE pos <= 25),
      g AS (SELECT DISTINCT least(a.id, b.id) AS unit_a_id, greatest(a.id, b.id) AS unit_b_id, round({base} * (0.6 + 0.4 * sim), 6) AS score FROM m WHERE {test})
      SELECT unit_a_id, unit_b_id, score FROM g WHERE score >= {threshold}"""


def _scan(rule: str, threshold: float):
    def run(spark, sf_dir):
        units, edges = scan_units(spark, sf_dir, rule)
        _, new = scan.scan(schema.empty_state(spark) | {"atomic_units": units, "relationships": edges}, NOW, threshold)
        return new.select("unit_a_id", "unit_b_id", "score")

    run.__doc__ = f"CON-01..10 where the {rule} rule finds conflicts: JOIN-07, JOIN-22, WIN-06, SET-07."
    return run


for _r, _t in (("numeric", 0.65), ("negation", 0.65), ("exclusive", 0.5), ("antonym", 0.5)):
    query(f"scan_{_r}", _scan_sql(_r, _t))(_scan(_r, _t))


@query("scan_explanation", """
    WITH u AS (SELECT c_custkey AS k, c_mktsegment || (c_custkey % 40)::VARCHAR AS s, floor(abs(c_acctbal))::BIGINT AS v FROM customer)
    SELECT lpad(a.k::VARCHAR, 9, '0') AS probe, lpad(b.k::VARCHAR, 9, '0') AS other, 'same subject and unit, conflicting values: ' || a.v::VARCHAR || ' vs ' || b.v::VARCHAR || ' ' AS explanation
    FROM u a JOIN u b ON a.s = b.s AND a.k < b.k WHERE abs(a.v - b.v) / greatest(a.v, b.v) > 0.10""")
def scan_explanation(spark, sf_dir):
    """CON-03, CON-07 over all pairs of a subject."""
    units, edges = scan_units(spark, sf_dir, "numeric")
    known = schema.settled(scan.facts(units, edges))
    pairs = scan.pairs_within(known, known).withColumn("cos", F.lit(None).cast("double"))
    return scan.score_pairs(pairs).select(F.col("a.id").alias("probe"), F.col("b.id").alias("other"), "explanation")


@query("review_resolve", f"""WITH c AS ({_scan_sql('numeric', 0.65)}), d AS (SELECT *, CASE WHEN unit_a_id::BIGINT % 3 = 0 THEN 'resolved_a' WHEN unit_a_id::BIGINT % 3 = 1 THEN 'resolved_b' ELSE 'dismissed' END AS r FROM c),
    lost AS (SELECT CASE r WHEN 'resolved_a' THEN unit_b_id ELSE unit_a_id END AS id, min(CASE r WHEN 'resolved_a' THEN unit_a_id ELSE unit_b_id END) AS by_unit FROM d WHERE r <> 'dismissed' GROUP BY 1)
    SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, CASE WHEN by_unit IS NULL THEN 'active' ELSE 'superseded' END AS status, by_unit AS superseded_by_unit_id FROM customer LEFT JOIN lost ON lost.id = lpad(c_custkey::VARCHAR, 9, '0')""")
def review_resolve(spark, sf_dir):
    """CON-13, MUT-02: every contradiction decided at once, losers superseded."""
    units, edges = scan_units(spark, sf_dir, "numeric")
    state, _ = scan.scan(schema.empty_state(spark) | {"atomic_units": units, "relationships": edges}, NOW)
    state["contradictions"] = store.checkpointed(state["contradictions"])
    which = F.col("unit_a_id").cast("bigint") % 3
    verdict = F.when(which == 0, "resolved_a").when(which == 1, "resolved_b").otherwise("dismissed")
    state = review.resolve_all(state, state["contradictions"].select("id", verdict.alias("resolution"), F.lit("checked").alias("note")), NOW)
    return state["atomic_units"].select("id", "status", "superseded_by_unit_id")


@query("search_vector", """
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20""")
def search_vector(spark, sf_dir):
    """SEA-02, SRT-06, FN-19: nearest to vector 0."""
    e = read(spark, sf_dir, "embeddings")
    return search.vector_top_k(e, e.where("vec_id = 0").first().embedding, 20, id_="vec_id").select("vec_id", "score")


@query("search_text", r"""
    WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations)
    SELECT conv_id, turn FROM t WHERE list_contains(w, 'thand') OR list_contains(w, 'chung')""")
def search_text(spark, sf_dir):
    """SEA-05, FLT-11: all turns that match (words whose stem is the word itself)."""
    turns = stored(spark, sf_dir, "messages-analysed", lambda: search.indexed(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", stemmed=False))
    return search.text_hits(turns, "thand or chung", "text").select("conv_id", "turn")


@query("knn_candidates", """
    WITH p AS (SELECT a.vec_id AS probe, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT probe, other, round(c, 6) AS cos, row_number() OVER (PARTITION BY probe ORDER BY c DESC, other) AS rank FROM p WHERE 1 - c < 0.6) SELECT probe, other, cos, rank::INTEGER AS rank FROM r WHERE rank <= 25""")
def knn_candidates(spark, sf_dir):
    """JOIN-08, WIN-06, FLT-10."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return scan.nearest_pairs(e, e, max_distance=0.6).select("probe", "other", F.round("cos", 6).alias("cos"), "rank")


SIM = """greatest(len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))), len(list_intersect(a.tg, b.tg)) / len(list_distinct(list_concat(a.tg, b.tg))),
    CASE WHEN starts_with(a.n, b.n) OR starts_with(b.n, a.n) THEN least(length(a.n), length(b.n)) / greatest(length(a.n), length(b.n)) ELSE 0 END)"""
NAMES = """n0 AS (SELECT DISTINCT p_brand || ' ' || p_type AS n0 FROM part), nm AS (SELECT n0 AS id, trim(lower(n0)) AS n FROM n0),
    g AS (SELECT id, n, list_distinct(list_filter(regexp_split_to_array(n, '[^a-z0-9$.]+'), lambda x: x <> '')) AS tk, list_distinct(list_transform(range(1, length(n) + 2), lambda i: substr('  ' || n || ' ', i, 3))) AS tg FROM nm)"""


@query("merge_suggest_text", f"WITH {NAMES}, p AS (SELECT a.id AS a, b.id AS b, round(CASE WHEN a.n = b.n THEN 1 ELSE {SIM} END, 6) AS score FROM g a JOIN g b ON a.id < b.id) SELECT a, b, score FROM p WHERE score >= 0.6")
def merge_suggest_text(spark, sf_dir):
    """ENT-02, ENT-04, JOIN-10, FN-13..17: all pairs of product lines alike by name."""
    names = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct()
    return E.name_pairs(names.select(F.col("name").alias("id"), "name", F.lit("other").alias("kind")), 0.6)


@query("merge_apply", f"""WITH {EDGES_SQL}, l AS (SELECT * FROM e WHERE t = 's2'), d AS (SELECT l.id FROM l JOIN e k ON k.s = l.s AND k.t = 's1')
    SELECT (SELECT count(*) FROM l) - (SELECT count(*) FROM d) AS relationships_repointed, (SELECT count(*) FROM d) AS relationships_dropped, 1::BIGINT AS aliases_added, 0::BIGINT AS descendants_flattened""")
def merge_apply(spark, sf_dir):
    """ENT-06, JOIN-14, MUT-03: supplier 2 merged into supplier 1."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit("tool").alias("kind"))
    state = schema.empty_state(spark) | {"entities": schema.conform(s.unionAll(p), "entities"), "relationships": schema.conform(edges_of(spark, sf_dir), "relationships")}
    _, outcome = E.merge(state, "s1", "s2", NOW)
    return outcome.select("relationships_repointed", "relationships_dropped", "aliases_added", "descendants_flattened")


@query("entity_list", f"""WITH {EDGES_SQL} SELECT 's' || s_suppkey::VARCHAR AS id, s_name AS name, (SELECT count(*) FROM e WHERE e.t = 's' || s_suppkey::VARCHAR) AS edge_count, 0::BIGINT AS alias_count FROM supplier WHERE s_name ILIKE '%supplier#%1%' ORDER BY s_name, 1 LIMIT 50""")
def entity_list(spark, sf_dir):
    """FLT-04, ENT-11, JOIN-17, SRT-04."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind"))
    state = schema.empty_state(spark) | {"entities": schema.conform(s, "entities"), "relationships": schema.conform(edges_of(spark, sf_dir), "relationships")}
    return listing.list_entities(state, "supplier#%1").select("id", "name", "edge_count", "alias_count")


@query("unit_list", """
    SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, 0::BIGINT AS provenance_count FROM customer ORDER BY c_custkey DESC, 1 LIMIT 50""")
def unit_list(spark, sf_dir):
    """FLT-02, SRT-02, JOIN-17."""
    units, _ = scan_units(spark, sf_dir, "numeric")
    return listing.list_units(schema.empty_state(spark) | {"atomic_units": units}, kind="claim", status="active").select("id", "provenance_count")


@query("html_strip", r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '\1', 'g'), '>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    """FN-20."""
    return read(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("segment_paragraphs")
def segment_paragraphs(spark, sf_dir):
    """EXT-01, FN-26 over all texts."""
    return extract.segments(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "seq", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("content_hash"))


@query("sentences", r"""
    WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*?[.!?](?:[ \t\n\f\r]|$)|[^\n]+|\n')) AS s FROM documents) SELECT doc_id, count(*) AS pieces FROM p WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1""")
def sentences(spark, sf_dir):
    """FN-05: sentences that hold more than blanks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentence_pieces("text")).alias("s"))
    return docs.where(X.trimmed("s") != "").groupBy("doc_id").agg(F.count("*").alias("pieces"))


@query("statement_tokens", """
    WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' is not the ' || p_type), '[^a-z0-9$.]+'), lambda x: x <> '' AND x NOT IN (""" + STOPS + """))) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9$.]+'), lambda x: x <> '')) AS b FROM part)
    SELECT p_partkey, len(a)::INTEGER AS n, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, true AS negated FROM t""")
def statement_tokens(spark, sf_dir):
    """FN-06..09, SET-09."""
    s = F.concat("p_name", F.lit(" is not the "), "p_type")
    a, b = F.array_distinct(X.content_tokens(s)), X.content_tokens("p_type")
    return read(spark, sf_dir, "part").select("p_partkey", F.size(a).alias("n"), F.round(X.jaccard(a, b), 6).alias("jaccard"), X.is_negated(s).alias("negated"))


@query("throughput_5m", """
    SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(count(*) / 5.0, 6) AS per_minute, round(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS ok_ratio FROM events GROUP BY 1, 2""")
def throughput_5m(spark, sf_dir):
    """AGG-13, STR-09."""
    got = report.rates(read(spark, sf_dir, "events"), "ts", ["event_type"], "5 minutes", F.col("value") > 10)
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


LATENCY = "SELECT event_type, count(*) AS n, count(value) AS completed, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, CASE WHEN quantile_cont(value, 0.95) <= 150 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY 1"


@query("latency_percentiles", LATENCY)
def latency_percentiles(spark, sf_dir):
    """AGG-05, AGG-14."""
    return report.latency_report(read(spark, sf_dir, "events").withColumnRenamed("value", "ms"), ["event_type"])


@query("latency_gate", f"SELECT max(p95) AS worst_p95, sum(CASE WHEN p95 > 150 THEN 1 ELSE 0 END)::BIGINT AS over FROM ({LATENCY})")
def latency_gate(spark, sf_dir):
    """AGG-06."""
    return report.latency_gate(latency_percentiles(spark, sf_dir))


@query("quality_sample", """
    SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, 'claim' AS kind FROM customer ORDER BY sha256(lpad(c_custkey::VARCHAR, 9, '0') || '|42'), 1 LIMIT 100""")
def quality_sample(spark, sf_dir):
    """SRC-30, SRT-12."""
    units, _ = scan_units(spark, sf_dir, "numeric")
    return report.quality_sheet(units).select("id", "kind")


@query("graph_tiers", f"""WITH {EDGES_SQL}, d AS (SELECT node AS id, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT t FROM e) GROUP BY 1),
    h AS (SELECT id, 'hub' AS tier FROM d ORDER BY degree DESC, id LIMIT 20), t AS (SELECT id, 'tail' AS tier FROM d WHERE degree <= (SELECT quantile_disc(degree, 0.5) FROM d) ORDER BY sha256(id || '|42'), id LIMIT 20) SELECT * FROM h UNION ALL SELECT * FROM t""")
def graph_tiers(spark, sf_dir):
    """SRT-13, SET-05."""
    e = edges_of(spark, sf_dir)
    return report.tiers(e.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct(), e, 20)


@query("hub_graph")
def hub_graph(spark, sf_dir):
    """SRC-29: degrees of a generated graph with as many edges as lineitem has rows."""
    nodes, edges = report.hub_graph(spark, 2000, read(spark, sf_dir, "lineitem").count())
    return report.degree_stats(nodes, edges)


def _small_state(spark, sf_dir) -> dict[str, DataFrame]:
    units, edges = scan_units(spark, sf_dir, "exclusive")
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("kind"))
    units = units.withColumn("statement_hash", X.sha256_hex(F.concat("statement", "id")))
    return schema.empty_state(spark) | {"atomic_units": units, "relationships": edges, "entities": schema.conform(s, "entities")}


@query("bundle_roundtrip", """
    SELECT * FROM (VALUES ('atomic_units', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 0::BIGINT), ('relationships', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 0::BIGINT), ('entities', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), 0::BIGINT)) t(table_name, in_bundle, inserted, again)""")
def bundle_roundtrip(spark, sf_dir):
    """SRC-25, SRC-26, AGG-12: a bundle loaded into nothing, then again into what it gave."""
    lines = store.checkpointed(bundle.export(_small_state(spark, sf_dir), NOW).select("value"))
    state, first = bundle.load(schema.empty_state(spark), lines)
    _, second = bundle.load(state, lines)
    return first.where("in_bundle > 0").join(second.select("table_name", F.col("inserted").alias("again")), "table_name")


@query("row_constraints", "SELECT 'relationships' AS table_name, 'self_loop' AS rule, (SELECT count(*) FROM supplier) AS n")
def row_constraints(spark, sf_dir):
    """FLT-16, MUT-08: violations, after adding a self loop for every supplier."""
    state = _small_state(spark, sf_dir)
    loops = state["entities"].select(F.col("id").alias("source_entity_id"), F.col("id").alias("target_entity_id"), F.concat(F.lit("loop"), "id").alias("id"))
    state["relationships"] = state["relationships"].unionByName(schema.conform(loops, "relationships"))
    return schema.violations(state)


@query("gauges", "SELECT * FROM (VALUES ('contradictions_open', 0::BIGINT), ('scan_backlog', (SELECT count(*) FROM customer)), ('extraction_backlog', 0::BIGINT)) t(gauge, value)")
def gauges(spark, sf_dir):
    """AGG-01, SRC-28."""
    return report.gauges(_small_state(spark, sf_dir))


@query("stream_units", f"WITH s AS (SELECT {duck(FIRST)} AS t FROM part) SELECT DISTINCT sha256(regexp_replace(trim(lower(t)), '[.]+$', '')) AS statement_hash FROM s")
def stream_units(spark, sf_dir):
    """STR-01, STR-03, STR-05, STR-08: the extraction stream, over four files in batches of two, until nothing is left."""
    base = f"{store.checkpoint_folder(spark)}/lorekeep/stream-{uuid.uuid4().hex}"
    said(spark, sf_dir, "part", "p_partkey", FIRST).repartition(4, "anchor_id").write.parquet(f"{base}/in")
    stream = workers.unit_stream(workers.chunk_stream(spark, f"{base}/in", 2)).writeStream.foreachBatch(workers.once_per_key(f"{base}/out", "statement_hash"))
    stream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("statement_hash")


@query("file_classify", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'document_pdf' WHEN 1 THEN 'document_markdown' WHEN 2 THEN 'image_screenshot' WHEN 3 THEN 'image_photo' END AS kind FROM documents""")
def file_classify(spark, sf_dir):
    """SRC-15."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.pdf", "b.MD", "c.png", "d.jpeg", "e.exe")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", ingest.classify(F.lit("file"), names, F.lit("application/octet-stream")).alias("kind"))


@query("message_parents", "SELECT conv_id, count(*) - 1 AS with_parent FROM conversations GROUP BY 1")
def message_parents(spark, sf_dir):
    """SRC-13, JOIN-24: each turn's parent is the one before it."""
    c = read(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    m = F.struct(F.col("seq").cast("string").alias("external_id"), (F.col("seq") - 1).cast("string").alias("parent_external_id"), "role", F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("model"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("created_at"))
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", m.alias("m")))), lambda x: x["m"]).alias("messages"))
    rows = rows.select(F.lit("a").alias("artifact_id"), F.lit(0).alias("position"), F.col("conv_id").cast("string").alias("external_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), "messages", F.lit(None).cast("string").alias("error"))
    state = ingest.persist_conversations(schema.empty_state(spark), rows, "generic")
    got = state["messages"].join(state["conversations"].select(F.col("id").alias("conversation_id"), F.col("external_id").alias("conv")), "conversation_id")
    return got.groupBy(F.col("conv").cast("bigint").alias("conv_id")).agg(F.count("parent_message_id").alias("with_parent"))
