"""Benchmark, sampling and metric reports (AGG-01..15, SRC-28..30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.graph import degrees

# Relation types of generated graphs, and the latency line in milliseconds.
RELATIONS = ("uses", "has", "prefers", "is", "lives_in", "works_at", "decided_on", "defined_as")
LATENCY_LINE = 150.0


def hub_graph(spark: SparkSession, nodes: int, edges: int, alpha: float = 3.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SRC-29, WIN-04, JOIN-20: (entities, relationships) in which few nodes have most edges.

    An endpoint is node 1 + floor(u^alpha nodes) for a uniform u; u comes from a hash of (edge, seed), so a lost task
    makes the same rows again. Distinct, without self loops.
    """
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40))
    end = lambda salt: (F.lit(1) + F.floor(F.pow(u(salt), F.lit(alpha)) * nodes)).cast("bigint")
    name = lambda i: F.format_string("e%09d", i)
    kind = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(len(RELATIONS))) + 1).cast("int"))
    rows = spark.range(edges).select(end(1).alias("s"), end(2).alias("t"), kind.alias("relation_type")).where("s <> t").distinct()
    made = rows.select(F.concat_ws("-", name(F.col("s")), name(F.col("t")), "relation_type").alias("id"), name(F.col("s")).alias("source_entity_id"), name(F.col("t")).alias("target_entity_id"), "relation_type", F.lit(1.0).alias("confidence"), F.lit("active").alias("status"))
    return spark.range(1, nodes + 1).select(name(F.col("id")).alias("id"), name(F.col("id")).alias("name")), made


def degree_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-04: max, 90 % and median degree (values that occur) and the skew of max to median."""
    d = degrees(entities, edges)
    pick = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY degree)")
    return d.agg(F.max("degree").alias("max_degree"), pick(0.9).cast("bigint").alias("p90_degree"), pick(0.5).cast("bigint").alias("p50_degree")).withColumn("skew", F.round(F.col("max_degree") / F.greatest("p50_degree", F.lit(1)), 6))


def tiers(entities: DataFrame, edges: DataFrame, per_tier: int, seed: int = 42) -> DataFrame:
    """SRT-12, SRT-13, SET-05: (id, tier): the hubs of most edges, and a seeded sample of nodes up to the median degree."""
    d = degrees(entities, edges).where("degree > 0")
    middle = d.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").alias("m"))
    hubs = d.orderBy(F.desc("degree"), "id").limit(per_tier).select("id", F.lit("hub").alias("tier"))
    tail = d.join(F.broadcast(middle), F.col("degree") <= F.col("m")).orderBy(F.sha2(F.concat_ws("|", "id", F.lit(str(seed))), 256), "id").limit(per_tier)
    return hubs.unionAll(tail.select("id", F.lit("tail").alias("tier")))


def latency_report(timings: DataFrame, by: list[str], line: float = LATENCY_LINE) -> DataFrame:
    """AGG-05: n, completed, p50, p95, p99 (interpolated) of ms by group, and PASS where p95 is within the line."""
    p = lambda q: F.round(F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY ms)"), 6).alias(f"p{round(q * 100)}")
    out = timings.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("ms").isNotNull()).alias("completed"), p(0.5), p(0.95), p(0.99))
    return out.withColumn("verdict", F.when((F.col("completed") == F.col("n")) & (F.col("p95") <= line), "PASS").otherwise("FAIL"))


def latency_gate(report: DataFrame, line: float = LATENCY_LINE) -> DataFrame:
    """AGG-06: the worst p95 and how many groups are over the line."""
    return report.agg(F.max("p95").alias("worst_p95"), F.count_if(F.coalesce(F.col("p95") > line, F.lit(True))).alias("over"))


def quality_sheet(units: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """SRC-30, SRT-12: a review sheet of n units in hash order, which any engine can repeat; usable is for the reviewer."""
    return units.orderBy(F.sha2(F.concat_ws("|", "id", F.lit(str(seed))), 256), "id").limit(n).select("id", "kind", "statement", "confidence", F.lit("").alias("usable"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def quality_score(sheet: DataFrame, gate: float = 70.0) -> DataFrame:
    """AGG-11: share of usable rows and the verdict; a sheet with unmarked rows is refused, not scored."""
    mark = F.lower(F.trim(F.coalesce("usable", F.lit(""))))
    out = sheet.agg(F.count("*").alias("n"), F.count_if(mark.isin("y", "yes", "1", "true")).alias("usable"), F.count_if(mark == "").alias("unmarked"))
    percent = F.when(F.col("unmarked") == 0, F.round(100 * F.col("usable") / F.greatest("n", F.lit(1)), 6))
    return out.withColumn("percent", percent).withColumn("verdict", F.when(F.col("unmarked") > 0, "INCOMPLETE").when(percent >= gate, "PASS").otherwise("FAIL"))


def rates(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", ok: Column | None = None) -> DataFrame:
    """AGG-13, STR-09: counts, per-minute rates and success ratios in tumbling windows."""
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60
    good = F.lit(True) if ok is None else ok
    out = events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(good).alias("ok"))
    return out.select(F.col("w.start").alias("start"), *by, "n", F.round(F.col("n") / minutes, 6).alias("per_minute"), F.round(F.col("ok") / F.greatest("n", F.lit(1)), 6).alias("ok_ratio"))


def histogram(events: DataFrame, value: str, by: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """AGG-14, SRC-28: (by, le, n): how many values are at most each bound, and all of them as +Inf; nulls do not count."""
    known = events.where(F.col(value).isNotNull())
    counts = known.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")


def exposition(gauge_rows: DataFrame, histograms: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """SRC-28: (line) in the text format of metric scrapers, from gauges() and histogram() rows."""
    one = gauge_rows.select(F.concat_ws(" ", "gauge", F.col("value").cast("string")).alias("line"))
    tags = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in [*labels, "le"]])
    return one.unionAll(histograms.select(F.concat(F.lit(f"{name}_bucket{{"), tags, F.lit("} "), F.col("n").cast("string"))))


def gauges(state: dict[str, DataFrame]) -> DataFrame:
    """AGG-01, SRC-28, STR-07: open contradictions, units to scan, and files to extract, as (gauge, value)."""
    one = lambda name, df, cond: df.agg(F.count_if(cond).alias("value")).select(F.lit(name).alias("gauge"), "value")
    out = one("contradictions_open", state["contradictions"], F.col("status") == "open")
    out = out.unionByName(one("scan_backlog", state["atomic_units"], F.col("contradiction_scanned_at").isNull() & (F.col("status") == "active")))
    return out.unionByName(one("extraction_backlog", state["documents"], F.col("extraction_status") == "pending"))


def sample_with_context(state: dict[str, DataFrame], units: DataFrame) -> DataFrame:
    """JOIN-19: units with their first provenance (by id), its artifact's file, their subject's name, and their count of provenance rows."""
    p = state["atomic_unit_provenance"].groupBy(F.col("atomic_unit_id").alias("id")).agg(F.min_by(F.struct("artifact_id", "quote"), "id").alias("p"), F.count("*").alias("sightings"))
    a = state["artifacts"].select(F.col("id").alias("artifact_id"), "filename", "source_platform")
    e = state["entities"].select(F.col("id").alias("subject_entity_id"), F.col("name").alias("subject"))
    out = units.join(p, "id", "left").withColumn("artifact_id", F.col("p.artifact_id")).withColumn("quote", F.col("p.quote")).drop("p")
    return out.join(a, "artifact_id", "left").join(e, "subject_entity_id", "left").withColumn("sightings", F.coalesce("sightings", F.lit(0)))
