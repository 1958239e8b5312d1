"""Entity suggestions, merges, dismissals and aliases (ENT-02..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators.listing import BadRequestError, NotFoundError, clamp
from lorekeep.operators.scan import nearest_pairs
from lorekeep.plans import schema

# The suggestion threshold, and how many live entities (by name) one call looks at unless told otherwise.
THRESHOLD, MOST = 0.6, 2000
NO_UNIT = "00000000-0000-0000-0000-000000000000"
#: Longs of 64 bits by which name_pairs() rules a pair out where it is met, and pairs that are sent to all tasks.
MASKS, BROADCAST_ROWS = 8, 100_000


def _marked(df: DataFrame, what: str) -> DataFrame:
    """df with slack and mask: a bit by hash for each part of the array, and how many of its parts share a bit with another."""
    marks = F.transform(what, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * MASKS)).cast("int"))
    word = lambda w: F.aggregate(F.filter("_marks", lambda b: F.shiftright(b, 6) == w), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)))))
    out = df.withColumn("_marks", F.array_distinct(marks)).withColumn("slack", F.size(what) - F.size("_marks"))
    return out.withColumns({f"mask_{w}": word(w) for w in range(MASKS)}).drop("_marks")


def _sharing(rare: DataFrame, t: float) -> DataFrame:
    """(id, other) that meet on a key and may have a likeness of t, the one with fewer parts first. Pairs are ruled out where
    they are met, and only the others are shuffled: by the places of the key, as no rarer part is shared, and by the masks,
    as no more parts are in common than bits that both have and the lesser slack.
    """
    share, n = t / (1 + t), 8 * rare.sparkSession.sparkContext.defaultParallelism
    rows = rare.withColumn("h", F.xxhash64("id"))
    few = rows.where(F.col("at") <= F.col("m") - F.ceil(2 * share * F.col("m") - 1e-9) + 1)
    a, b = few.repartition(n, "key").alias("a"), rows.repartition(n, "key").alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    before = (x("m") < y("m")) | ((x("m") == y("m")) & ((x("h") < y("h")) | ((x("h") == y("h")) & (x("id") < y("id")))))
    least = share * (x("m") + y("m")) - 1e-6
    common = sum((F.bit_count(x(f"mask_{w}").bitwiseAND(y(f"mask_{w}"))) for w in range(MASKS)), F.least(x("slack"), y("slack")))
    may = (F.least(x("m") - x("at"), y("m") - y("at")) + 1 >= least) & (common >= least)
    return a.join(b, (x("key") == y("key")) & before & may).select(x("id"), y("id").alias("other"))


def name_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """JOIN-10: (a, b, score) with a.id < b.id of names at least threshold alike, of compatible kinds.

    Two names are that much alike by tokens, trigrams or prefix only if they share one of their rarest: of n tokens or
    trigrams a set of likeness t shares one of the n - ceil(t n) + 1 rarest of either side, and a prefix of at least t
    of a name's length is a prefix of both. So entities meet on few and rare keys, by an equi-join. Where even rare parts are
    shared by many names, most pairs that meet are ruled out at once (see _sharing()). Kinds may differ only if one is 'other'.
    """
    named = schema.settled(entities.select("id", "kind", X.normalize_name("name").alias("n")).where("n <> ''").withColumn("tokens", F.array_distinct(X.tokens("n"))).withColumn("trigrams", X.trigrams("n")))
    t = max(threshold - 1e-6, 1e-9)  # scores are rounded
    met = None
    for what in ("tokens", "trigrams"):
        parts = named.select("id", F.size(what).alias("m"), F.explode(what).alias("key"))
        by_count = parts.join(parts.groupBy("key").count(), "key")
        place = F.row_number().over(Window.partitionBy("id").orderBy("count", "key"))
        kept = by_count.withColumn("at", place).where(F.col("at") <= F.col("m") - F.ceil(t * F.col("m") - 1e-9) + 1).select("id", "m", "key", "at")
        masks = schema.settled(_marked(named.select("id", what), what).drop(what))
        found = _sharing(schema.settled(kept.join(masks, "id")), t)
        met = found if met is None else met.unionByName(found)
    start = lambda n: F.concat(F.lit("=" * 3), F.substring("n", F.lit(1), n))
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(t * F.length("n") - 1e-9)).cast("int"), F.length("n"))
    begins = named.select("id", F.explode(F.transform(lengths, lambda k: start(k))).alias("key"))
    whole = named.select("id", start(F.length("n")).alias("key"))
    other = lambda df: df.select("key", F.col("id").alias("other"))
    met = met.unionByName(whole.join(other(begins), "key").where("id <> other").select("id", "other"))
    met = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    side = lambda s: named.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "n", "tokens", "trigrams")])
    rows = met.join(side("a"), "a").join(side("b"), "b").where("kind_a = kind_b OR kind_a = 'other' OR kind_b = 'other'")
    score = X.name_similarity(F.col("n_a"), F.col("n_b"), tuple(F.col(c) for c in ("tokens_a", "tokens_b", "trigrams_a", "trigrams_b")))
    return rows.select("a", "b", F.explode(F.array(F.round(score, 6))).alias("score")).where(F.col("score") >= threshold)


def merge_suggestions(state: dict[str, DataFrame], threshold: float | None = None, limit: int | None = None, most: int | None = MOST) -> DataFrame:
    """ENT-02..05: pairs that may be one entity: by embedding where both have one, else by name; dismissed pairs are out.

    most is how many live entities are looked at, by name (ENT-03); None looks at all of them.
    """
    threshold = max(0.0, min(1.0, THRESHOLD if threshold is None else threshold))
    live = state["entities"].where("merged_into_entity_id IS NULL")
    live = schema.settled(live if most is None else live.orderBy("name", "id").limit(most))
    near = nearest_pairs(live, live, live.count(), 1 - threshold + 1e-12).where("probe < other").select(F.col("probe").alias("a"), F.col("other").alias("b"), F.round("cos", 6).alias("score"), F.lit("embedding:cosine").alias("method"))
    named = name_pairs(live, threshold).withColumn("method", F.lit("rule:name-similarity")).join(near.select("a", "b"), ["a", "b"], "left_anti")
    out = state["entity_merge_audit"].where("action = 'dismiss'").select(F.least("winner_entity_id", "loser_entity_id").alias("a"), F.greatest("winner_entity_id", "loser_entity_id").alias("b"))
    pairs = schema.settled(near.unionByName(named))
    if pairs.count() <= BROADCAST_ROWS:  # then dismissals, however many, are not shuffled
        out = out.join(F.broadcast(pairs.select("a", "b")), ["a", "b"], "left_semi")
    pairs = pairs.join(out, ["a", "b"], "left_anti")
    name = lambda s: live.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").orderBy(F.desc("score"), "a", "b").limit(clamp(limit, 50, 1, 500))


def _live_pair(state: dict[str, DataFrame], winner: str, loser: str) -> dict:
    if winner == loser:
        raise BadRequestError("an entity cannot be merged with itself")
    found = {r.id: r for r in state["entities"].where(F.col("id").isin(winner, loser)).collect()}
    for i in (winner, loser):
        if i not in found:
            raise NotFoundError(f"entity {i}")
        if found[i].merged_into_entity_id:
            raise BadRequestError(f"entity {i} is already merged")
    return found


def repointed_edges(edges: DataFrame, winner: Column, is_loser, extra: list[str] | None = None) -> DataFrame:
    """Edges as they are after their loser ends become winners, with dropped saying why an edge goes: 'loop' or 'same'.

    An edge of the loser goes where another edge already is what it would become.
    """
    extra = extra or []
    moved = edges.withColumn("_s", F.when(is_loser("source_entity_id"), winner).otherwise(F.col("source_entity_id"))).withColumn("_t", F.when(is_loser("target_entity_id"), winner).otherwise(F.col("target_entity_id")))
    moved = moved.withColumn("_touched", is_loser("source_entity_id") | is_loser("target_entity_id")).withColumn("_u", F.coalesce("atomic_unit_id", F.lit(NO_UNIT)))
    loop = F.col("_touched") & (F.col("_s") == F.col("_t"))
    key = [*extra, "_s", "_t", "relation_type", "_u"]
    here = edges.select(*extra, F.col("source_entity_id").alias("_s"), F.col("target_entity_id").alias("_t"), "relation_type", F.coalesce("atomic_unit_id", F.lit(NO_UNIT)).alias("_u")).distinct().withColumn("_there", F.lit(True))
    moved = moved.join(here, key, "left")
    return moved.withColumn("dropped", F.when(loop, "loop").when(F.col("_touched") & F.coalesce("_there", F.lit(False)), "same"))


def merge(state: dict[str, DataFrame], winner: str, loser: str, now, note: str | None = None, actor: str = "local-user") -> tuple[dict[str, DataFrame], DataFrame]:
    """ENT-06, ENT-07: (state with the loser merged into the winner, one row of what changed).

    Counts are of the state before: aliases added (the loser's name and its aliases, any case, if the winner lacks them),
    units repointed, units requeued (those, and the winner's active units that had been scanned), edge ends repointed,
    edges dropped (loops and duplicates), and entities that were merged into the loser and now point at the winner.
    """
    _live_pair(state, winner, loser)
    w, is_loser = F.lit(winner), lambda c: F.col(c) == loser
    entities, aliases, units, edges = (state[t] for t in ("entities", "entity_aliases", "atomic_units", "relationships"))
    names = entities.where(F.col("id") == loser).select(F.col("name").alias("alias")).union(aliases.where(F.col("entity_id") == loser).select("alias"))
    fresh = names.groupBy(F.lower("alias").alias("key")).agg(F.min("alias").alias("alias"))
    fresh = fresh.join(aliases.where(F.col("entity_id") == winner).select(F.lower("alias").alias("key")), "key", "left_anti")
    added = fresh.select(X.uuid_of("alias", w, F.col("key")).alias("id"), w.alias("entity_id"), "alias")
    mine, scanned = F.col("subject_entity_id") == loser, (F.col("subject_entity_id") == winner) & F.col("contradiction_scanned_at").isNotNull() & (F.col("status") == "active")
    new_units = schema.touched(units, mine | scanned, now).withColumn("contradiction_scanned_at", F.when(mine | scanned, F.lit(None)).otherwise(F.col("contradiction_scanned_at"))).withColumn("subject_entity_id", F.when(mine, w).otherwise(F.col("subject_entity_id")))
    moved = repointed_edges(edges, w, is_loser)
    kept = moved.where("dropped IS NULL").withColumn("source_entity_id", F.col("_s")).withColumn("target_entity_id", F.col("_t")).select(*edges.columns)
    below = F.col("merged_into_entity_id") == loser
    new_entities = schema.touched(entities, is_loser("id") | below, now).withColumn("merged_into_entity_id", F.when(is_loser("id") | below, w).otherwise(F.col("merged_into_entity_id")))
    audit = entities.sparkSession.createDataFrame([(winner, loser, "merge", actor, note)], "winner_entity_id string, loser_entity_id string, action string, actor string, note string")
    audit = audit.withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("id", X.uuid_of("merge", w, F.col("loser_entity_id"), F.col("created_at")))
    ends = F.sum(F.when(F.col("dropped").isNull(), is_loser("source_entity_id").cast("int") + is_loser("target_entity_id").cast("int")).otherwise(0))
    parts = {"aliases_added": (added, F.count("*")), "units_repointed": (units, F.count_if(mine)), "units_requeued_for_scan": (units, F.count_if(mine | scanned)), "relationships_repointed": (moved, F.coalesce(ends, F.lit(0))), "relationships_dropped": (moved, F.count("dropped")), "descendants_flattened": (entities, F.count_if(below))}
    outcome = schema.one_row({name: df.agg(n.cast("bigint").alias("n")) for name, (df, n) in parts.items()})
    return state | {
        "entities": new_entities, "entity_aliases": aliases.where(~is_loser("entity_id")).unionByName(added), "atomic_units": new_units, "relationships": schema.settled(kept),
        "entity_merge_audit": schema.grown(state["entity_merge_audit"], schema.conform(audit, "entity_merge_audit")),
    }, outcome.select(w.alias("winner_id"), F.lit(loser).alias("loser_id"), "*")


def dismiss(state: dict[str, DataFrame], a: str, b: str, now, note: str | None = None, actor: str = "local-user") -> dict[str, DataFrame]:
    """ENT-08: the pair is not suggested again, in either order."""
    if a == b:
        raise BadRequestError("a pair needs two entities")
    row = state["entities"].sparkSession.createDataFrame([(a, b, "dismiss", actor, note)], "winner_entity_id string, loser_entity_id string, action string, actor string, note string")
    row = row.withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("id", X.uuid_of("dismiss", F.col("winner_entity_id"), F.col("loser_entity_id"), F.col("created_at")))
    return state | {"entity_merge_audit": schema.grown(state["entity_merge_audit"], schema.conform(row, "entity_merge_audit"))}


def add_alias(state: dict[str, DataFrame], entity_id: str, alias: str) -> tuple[dict[str, DataFrame], bool]:
    """ENT-09: (state, whether it was new). The entity must be live, and no other live entity may have that name or alias."""
    alias = alias.strip()
    if not alias:
        raise BadRequestError("an alias cannot be blank")
    me = state["entities"].where(F.col("id") == entity_id).first()
    if me is None:
        raise NotFoundError(f"entity {entity_id}")
    if me.merged_into_entity_id:
        raise BadRequestError(f"entity {entity_id} is merged")
    live = state["entities"].where(F.col("merged_into_entity_id").isNull() & (F.col("id") != entity_id)).select(F.col("id").alias("entity_id"), "name")
    same = lambda c: F.lower(c) == alias.lower()
    if not live.where(same("name")).isEmpty() or not state["entity_aliases"].where(same("alias")).join(live, "entity_id", "left_semi").isEmpty():
        raise BadRequestError(f"{alias!r} names another entity")
    if not state["entity_aliases"].where((F.col("entity_id") == entity_id) & same("alias")).isEmpty():
        return state, False
    row = live.sparkSession.createDataFrame([(entity_id, alias)], "entity_id string, alias string").withColumn("id", X.uuid_of("alias", F.col("entity_id"), F.lower("alias")))
    return state | {"entity_aliases": schema.grown(state["entity_aliases"], row)}, True
