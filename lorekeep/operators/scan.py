"""Contradictions: candidates by subject and by embedding, pair scores, and the scan (CON-01..11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.functions import text as X
from lorekeep.functions.workers import reachable
from lorekeep.plans import schema
from lorekeep.plans.store import appended

# Relations of which a subject has one at most, base scores by rule, and the scan's parameters.
FUNCTIONAL = ("lives_in", "works_at", "is", "decided_on")
BASE = {"rule:numeric-mismatch": 0.80, "rule:negation": 0.75, "rule:exclusive-assignment": 0.70, "rule:antonym": 0.60}
NEAREST, MAX_DISTANCE, THRESHOLD = 25, 0.35, 0.65
#: Vectors in a row of a table, in a side of a tile at most, and compared with 512 others at once.
VECTORS, TILE, COMPARED = 2048, 65_536, 4096
#: Partners by subject, all subjects together, that are sent to all tasks (about a kilobyte each).
BROADCAST_ROWS = 10_000
#: Parts of a subject's units, by id, where all its pairs are met.
BLOCKS = 4
#: Rows of pairs that one task sorts (some hundred bytes each), and what score_pairs() reads of a unit.
PART_ROWS = 500_000
SCORED = ("id", "subject", "attrs", "created_at", "valid_from", "valid_to", "assignments", "words", "sides", "facing", "held", "single", "negated", "number", "measure")


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def facts(units: DataFrame, relationships: DataFrame) -> DataFrame:
    """JOIN-22: active units with what pair scoring reads; assignments are gathered by unit, not looked up one by one."""
    held = relationships.where(F.col("relation_type").isin(*FUNCTIONAL)).groupBy("atomic_unit_id").agg(F.collect_set(F.struct(F.col("source_entity_id").alias("src"), F.col("relation_type").alias("rel"), F.col("target_entity_id").alias("tgt"))).alias("assignments"))
    rows = units.where("status = 'active'").join(held.withColumnRenamed("atomic_unit_id", "id"), "id", "left")
    return features(rows.select("id", "statement", "attrs", F.col("subject_entity_id").alias("subject"), "valid_from", "valid_to", "created_at", "embedding", F.coalesce("assignments", F.array().cast("array<struct<src:string,rel:string,tgt:string>>")).alias("assignments")))


def features(rows: DataFrame) -> DataFrame:
    """What a unit brings to every pair: content words, its words that have an opposite, negation, its number and unit.

    Of the i-th pair of antonyms a unit has sides 2 i and 2 i + 1, and faces the other of the two: two units are opposed
    where one's sides meet what the other faces. Of its functional assignments it has held, their subjects and relations,
    and single, those with their target where there is but one: two units clash where they hold more in common than they
    agree on. So the rules for a pair are plain set operations, which Spark compiles; functions over arrays it does not.

    They are worked out once a unit; scan() stores them before units meet.
    """
    words = X.tokens("statement")
    has = lambda swap: F.array_compact(F.array(*[F.when(F.array_contains("poles", w), 2 * i + (j ^ swap)) for i, pair in enumerate(X.ANTONYMS) for j, w in enumerate(pair)]))
    poles = F.array(*[F.lit(w) for pair in X.ANTONYMS for w in pair])
    rows = rows.withColumn("poles", F.array_intersect(words, poles)).withColumn("sides", has(0)).withColumn("facing", has(1)).drop("poles")
    key = lambda x: F.concat(F.length(x["src"]).cast("string"), F.lit(":"), x["src"], F.lit("|"), x["rel"])
    good = F.filter("assignments", lambda x: x["rel"].isin(*FUNCTIONAL) & x["src"].isNotNull() & x["tgt"].isNotNull())
    rows = rows.withColumn("_kept", F.array_distinct(F.transform(good, lambda x: F.struct(key(x).alias("key"), x["tgt"].alias("tgt")))))
    rows = rows.withColumn("held", F.array_distinct(F.transform("_kept", lambda x: x["key"])))
    alone = F.filter("_kept", lambda x: F.size(F.filter("_kept", lambda y: y["key"] == x["key"])) == 1)
    rows = rows.withColumn("single", F.transform(alone, lambda x: F.concat(x["key"], F.lit("|"), x["tgt"]))).drop("_kept")
    number, unit = X.parse_number(F.col("attrs.value")), X.normalize_unit(F.col("attrs.unit"))
    return rows.withColumn("words", F.array_distinct(X.content_tokens("statement"))).withColumn("negated", X.is_negated("statement")).withColumn("number", number).withColumn("measure", unit)


def placed(units: DataFrame, k: int = NEAREST) -> DataFrame:
    """units with at: the place among their subject's units, newest first; null beyond the first k + 1."""
    newest = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("created_at"), "id"))
    first = units.where("subject IS NOT NULL").select("id", newest.alias("at")).where(F.col("at") <= k + 1)
    return units.join(first, "id", "left")


def by_subject(a, b, k: int = NEAREST) -> Column:
    """JOIN-07: whether b is among the k newest other units of a's subject, by their places (see placed()).

    A unit that is itself among the first k is no partner of its own, so the one at k + 1 is. Only the k + 1 newest units
    of a subject are anybody's partners: a subject that many units share costs no more than k partners each.
    """
    return F.coalesce((a["subject"] == b["subject"]) & (a["id"] != b["id"]) & ((b["at"] <= k) | ((b["at"] == k + 1) & (a["at"] <= k))), F.lit(False))


def nearest_pairs(units: DataFrame, probes: DataFrame, k: int = NEAREST, max_distance: float = MAX_DISTANCE, block: int = VECTORS) -> DataFrame:
    """JOIN-08, WIN-06: (probe, other, cos) with the k nearest units within max_distance of each probe, exactly.

    Vectors are dealt by hash to blocks of about ``block``, and blocks to a square of tiles, about four for each core, or
    more where a side would exceed TILE. So a vector is shuffled as often as a side has tiles, which does not grow with the
    table up to then, in the precision it is stored in. A tile is compared as matrix products, in double precision, and
    gives each probe its k best there and no more. Vectors of unequal size do not meet; null and zero vectors meet nothing.
    """
    reachable()
    kind = units.schema["id"].dataType.simpleString()
    wide = "double" if "array<double>" in (units.schema["embedding"].dataType.simpleString(), probes.schema["embedding"].dataType.simpleString()) else "float"

    def blocks(df: DataFrame, n: int, g: int, out: str, every: str) -> DataFrame:
        rows = df.where(F.col("embedding").isNotNull() & (X.norm(F.col("embedding")) > 0)).select("id", F.col("embedding").cast(f"array<{wide}>").alias("v"), F.size("embedding").alias("dim"))
        held = rows.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).alias("_at")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        held = held.select("dim", F.pmod("_at", F.lit(g)).alias(out), F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))
        return held.withColumn(every, F.explode(F.sequence(F.lit(0), F.lit(g - 1)).cast("array<bigint>")))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(t["ids"].combine_chunks().flatten().to_pylist())
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["flat"].chunks]).astype("f8").reshape(len(ids), -1)
        by_id = np.argsort(ids, kind="stable")
        return ids[by_id], (x / np.sqrt((x * x).sum(1, keepdims=True)))[by_id]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (mine, x), (others, y) = matrix(left), matrix(right)
            for at in range(0, len(mine), 512):
                best = None
                for to in range(0, len(others), COMPARED):
                    cos = x[at : at + 512] @ y[to : to + COMPARED].T
                    cos[mine[at : at + 512, None] == others[None, to : to + COMPARED]] = -2
                    i, j = np.nonzero(1 - cos < max_distance)
                    new = i, to + j, cos[i, j]
                    i, j, c = new if best is None else (np.concatenate(z) for z in zip(best, new, strict=True))
                    order = np.lexsort((j, -c, i))
                    i, j, c = i[order], j[order], c[order]
                    near = np.arange(len(i)) - np.searchsorted(i, i) < k
                    best = i[near], j[near], c[near]
                found.append((at + best[0], best[1], best[2]))
        i, j, c = (np.concatenate([f[z] for f in found]) if found else np.zeros(0, "i8") for z in range(3))
        return pa.table({"probe": pa.array(mine[i].tolist() if len(i) else [], ids_type), "other": pa.array(others[j].tolist() if len(i) else [], ids_type), "cos": pa.array(c, pa.float64())})

    ids_type = to_arrow_type(units.schema["id"].dataType)
    total = units.where("embedding IS NOT NULL").count()
    if not total:
        return units.sparkSession.createDataFrame([], f"probe {kind}, other {kind}, cos double, source int, rank int")
    asked = probes.count()
    cores = units.sparkSession.sparkContext.defaultParallelism
    g = max(-(-max(total, asked) // TILE), min(-(-total // 256), round((4 * cores) ** 0.5)))
    of = lambda rows: g * -(-rows // (g * block)) or g  # noqa: E731  as many blocks to each tile
    left, right = blocks(probes, of(asked), g, "l", "r"), blocks(units, of(total), g, "r", "l")
    pairs = left.groupBy("dim", "l", "r").cogroup(right.groupBy("dim", "l", "r")).applyInArrow(compare, f"probe {kind}, other {kind}, cos double")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("cos"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "other", "cos", F.lit(1).alias("source"), "rank")


def pairs_within(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b): all pairs a.id < b.id of a subject, of features(). Their number grows with the square of a subject's units.

    Both sides are dealt to blocks by id, and a pair of blocks of a subject is met alone, so no task holds a whole subject
    and a large one is shared by BLOCKS * BLOCKS of them.
    """
    side = lambda df, s: df.select("subject", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).alias(f"{s}_at"), F.struct(*SCORED).alias(s))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)).cast("array<bigint>"))
    left, right = side(one, "a").withColumn("b_at", every), side(two, "b").withColumn("a_at", every)
    n = 4 * one.sparkSession.sparkContext.defaultParallelism
    key = ["subject", "a_at", "b_at"]
    return left.repartition(n, *key).join(right.repartition(n, *key), key).where("a.id < b.id").select("a", "b")


def candidates(units: DataFrame, probes: DataFrame, k: int = NEAREST, max_distance: float = MAX_DISTANCE, columns: Sequence[str] | None = None) -> DataFrame:
    """CON-01, SET-07: (a, b, cos): a probe and a partner by subject or else by embedding, as structs of columns of
    features() (None: all); a pair met twice counts once.

    units and probes are of placed(). Partners by subject are joined with all that scoring reads, which are at most k + 1
    rows a subject, so a pair is scored where it is met, and pairs are never sorted or shuffled with their texts. cos is
    the pair's cosine where both have embeddings, whichever way it was found.
    """
    kept = list(columns or [c for c in units.columns if c not in ("embedding", "at")])
    side = lambda df, s: df.select(F.col("subject").alias(f"{s}_subject"), F.col("id").alias(f"{s}_id"), F.struct(*kept, "at").alias(s), F.col("embedding").alias(f"e_{s}"))
    one, first = side(probes, "a"), units.where("at IS NOT NULL")
    n = max(parts_for(probes.count() * k), 2 * units.sparkSession.sparkContext.defaultParallelism)
    two = side(first, "b")
    if first.count() <= BROADCAST_ROWS:  # then a subject's probes are dealt to all tasks
        dealt, two = one.repartition(n), F.broadcast(two)
    else:
        dealt = one.repartition(n, "a_subject")
    vectors = not units.where("embedding IS NOT NULL").isEmpty()
    near = nearest_pairs(units, probes, k, max_distance).select(F.col("probe").alias("a_id"), F.col("other").alias("b_id"))
    met = dealt.join(two, F.col("a_subject") == F.col("b_subject")).where(by_subject(F.col("a"), F.col("b"), k)).select("a", "b", "e_a", "e_b")
    else_ = near.join(one, "a_id").join(side(units, "b"), "b_id").where(~by_subject(F.col("a"), F.col("b"), k)).select("a", "b", "e_a", "e_b")
    if not vectors:
        return met.select("a", "b", F.lit(None).cast("double").alias("cos"))
    return met.unionAll(else_).select("a", "b", X.cosine(F.col("e_a"), F.col("e_b")).alias("cos"))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """CON-02..09: pairs with score, method, explanation where a rule finds a conflict; others are left out.

    pairs has structs a and b of features() and a column cos (null: token likeness stands in). Rules go numeric,
    negation, exclusive, antonym; the first that holds decides.
    """
    a, b = F.col("a"), F.col("b")
    like = X.jaccard(a["words"], b["words"])  # worked out only where a rule or the score asks for it
    larger = F.greatest(F.abs(a["number"]), F.abs(b["number"]))
    numeric = (a["attrs"]["pattern"] == "numeric") & (b["attrs"]["pattern"] == "numeric") & (a["subject"] == b["subject"]) & (a["measure"] == b["measure"]) & (larger > 0) & (F.abs(a["number"] - b["number"]) / larger > 0.10)
    negation = (a["negated"] != b["negated"]) & (like >= 0.5)
    clash = F.filter(a["assignments"], lambda x: x["rel"].isin(*FUNCTIONAL) & F.exists(b["assignments"], lambda y: (x["src"] == y["src"]) & (x["rel"] == y["rel"]) & (x["tgt"] != y["tgt"])))
    exclusive = (F.size(a["held"]) > 0) & (F.size(b["held"]) > 0) & (F.size(F.array_intersect(a["held"], b["held"])) > F.size(F.array_intersect(a["single"], b["single"])))
    opposed = F.arrays_overlap(a["sides"], b["facing"])
    antonym = F.element_at(F.array(*[F.lit(f"'{x}'/'{y}'") for x, y in X.ANTONYMS]), (F.shiftright(F.array_min(F.array_intersect(a["sides"], b["facing"])), 1) + 1).cast("int"))
    near = F.format_string("%.2f", like)
    holds = lambda test: F.coalesce(test, F.lit(False))
    found = F.when(holds(numeric), 0).when(holds(negation), 1).when(holds(exclusive), 2).when(opposed & (like >= 0.3), 3)
    rows = pairs.withColumn("_rule", F.explode(F.array(found))).where("_rule IS NOT NULL")  # a generator, so the rules are worked out once
    of = lambda *by_rule: F.coalesce(*[F.when(F.col("_rule") == i, v) for i, v in enumerate(by_rule)])
    explanation = of(
        F.concat(F.lit("same subject and unit, conflicting values: "), _number(a["number"]), F.lit(" vs "), _number(b["number"]), F.lit(" "), a["measure"]),
        F.concat(F.lit("one statement negates the other over the same content (overlap "), near, F.lit(")")),
        F.concat(F.lit("same subject holds functional relation '"), F.get(clash, F.lit(0))["rel"], F.lit("' to two different entities")),
        F.concat(F.lit("opposing predicates "), antonym, F.lit(" over similar content (overlap "), near, F.lit(")")),
    )
    damp = F.when(X.windows_disjoint(a["valid_from"], a["valid_to"], b["valid_from"], b["valid_to"]), 0.5).otherwise(1.0)
    score = of(*BASE.values()) * (0.6 + 0.4 * F.coalesce(F.col("cos"), like)) * damp
    return rows.select(*pairs.columns, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), of(*map(F.lit, BASE)).alias("method"), explanation.alias("explanation"))


def judged(scored: DataFrame, reply: str = "reply") -> DataFrame:
    """CON-08, CON-11: scores blended with a judge's JSON {contradicts, confidence, why}; no or bad replies change nothing."""
    v = F.from_json(reply, "struct<contradicts:boolean,confidence:double,why:string>")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"], F.lit(0.5))))
    new = F.when(v["contradicts"].isNull(), F.col("score")).when(v["contradicts"], 0.5 * F.col("score") + 0.5 * sure).otherwise(0.4 * F.col("score"))
    why = F.when(v["contradicts"].isNotNull() & (F.coalesce(v["why"], F.lit("")) != ""), F.concat("explanation", F.lit(" — judge: "), v["why"])).otherwise(F.col("explanation"))
    return scored.withColumn("explanation", why).withColumn("score", F.round(new, 6)).drop(reply)


def _first_seen(seen: DataFrame) -> DataFrame:
    """Of the rows of a pair (unit_a_id, unit_b_id) the one of the least _by; in parts of bounded size, as pairs are k a unit."""
    first = F.row_number().over(Window.partitionBy("unit_a_id", "unit_b_id").orderBy("_by"))
    seen = schema.settled(seen)
    dealt = seen.repartition(parts_for(seen.count()), "unit_a_id", "unit_b_id")
    return dealt.withColumn("_first", first).where("_first = 1")


def scan(state: dict[str, DataFrame], now, threshold: float = THRESHOLD, k: int = NEAREST, max_distance: float = MAX_DISTANCE, judge: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """CON-10: score every unscanned active unit against its candidates; (state, new contradictions).

    A pair is stored once, under the lesser id first, as seen from the unit that is scanned first (created_at, id).
    """
    known = schema.settled(placed(facts(state["atomic_units"], state["relationships"]), k))
    waiting = state["atomic_units"].where("contradiction_scanned_at IS NULL AND status = 'active'").select("id")
    probes = known.join(waiting, "id", "left_semi")
    scored = score_pairs(candidates(known, probes, k, max_distance, None if judge else SCORED))
    if judge:
        scored = judged(judge(scored.withColumn("probe", F.col("a.id")).withColumn("other", F.col("b.id"))))
    seen = scored.where(F.col("score") >= threshold).select(F.least("a.id", "b.id").alias("unit_a_id"), F.greatest("a.id", "b.id").alias("unit_b_id"), F.struct(F.col("a.created_at").alias("created_at"), F.col("a.id").alias("probe")).alias("_by"), F.struct("score", F.col("method").alias("detection_method"), "explanation").alias("_v"))
    stamp = F.lit(now).cast("timestamp")
    rows = _first_seen(seen).select(
        X.uuid_of("contradiction", F.col("unit_a_id"), F.col("unit_b_id")).alias("id"), "unit_a_id", "unit_b_id", "_v.*", F.lit("open").alias("status"), stamp.alias("detected_at"), stamp.alias("updated_at")
    )
    new = schema.conform(rows, "contradictions").join(state["contradictions"].select("unit_a_id", "unit_b_id"), ["unit_a_id", "unit_b_id"], "left_anti").select(*state["contradictions"].columns)
    new = schema.settled(new)
    audit = new.select(X.uuid_of("audit", F.col("id"), "detected").alias("id"), F.col("id").alias("contradiction_id"), F.lit("detected").alias("action"), F.lit("scanner").alias("actor"), F.lit("open").alias("to_status"), F.col("explanation").alias("note"), stamp.alias("created_at"))
    done = F.when(F.col("contradiction_scanned_at").isNull() & (F.col("status") == "active"), stamp).otherwise(F.col("contradiction_scanned_at"))
    return state | {
        "contradictions": appended(state["contradictions"], new),
        "contradiction_audit": schema.grown(state["contradiction_audit"], schema.conform(audit, "contradiction_audit")),
        "atomic_units": schema.touched(state["atomic_units"], F.col("contradiction_scanned_at").isNull() & (F.col("status") == "active"), now).withColumn("contradiction_scanned_at", done),
    }, new
