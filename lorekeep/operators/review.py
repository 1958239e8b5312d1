"""Review of contradictions: details, resolutions and notes (CON-12..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators.listing import BadRequestError, get_one, with_provenance
from lorekeep.plans import schema

RESOLUTIONS = ("resolved_a", "resolved_b", "both_valid", "dismissed")


def detail(state: dict[str, DataFrame], id_: str) -> DataFrame:
    """CON-12: a contradiction with both units, their provenance, and its audit trail, oldest first."""
    c = get_one(state["contradictions"], id_, "contradiction")
    ids = c.select(F.explode(F.array("unit_a_id", "unit_b_id")).alias("id"))
    units = with_provenance(state, state["atomic_units"].drop("embedding").join(ids, "id", "left_semi"))
    side = lambda s: units.select(F.col("id").alias(f"unit_{s}_id"), F.struct(*units.columns).alias(f"unit_{s}"))
    trail = state["contradiction_audit"].where(F.col("contradiction_id") == id_).groupBy(F.col("contradiction_id").alias("id"))
    trail = trail.agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("audit_id"), "action", "actor", "from_status", "to_status", "note"))).alias("audit"))
    return c.join(side("a"), "unit_a_id").join(side("b"), "unit_b_id").join(trail, "id", "left")


def _audit(state: dict[str, DataFrame], rows: DataFrame, action: str, actor, note, now, before, after) -> DataFrame:
    stamp = F.lit(now).cast("timestamp")
    out = rows.select(X.uuid_of("audit", F.col("id"), action, stamp).alias("id"), F.col("id").alias("contradiction_id"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), before.alias("from_status"), after.alias("to_status"), note.alias("note"), stamp.alias("created_at"))
    return schema.grown(state["contradiction_audit"], schema.conform(out, "contradiction_audit"))


def resolve_all(state: dict[str, DataFrame], decisions: DataFrame, now, actor: str = "local-user") -> dict[str, DataFrame]:
    """CON-13 for many contradictions at once: decisions has id, resolution and note; only open ones change.

    The losing unit is superseded by the other, its validity closed now if it was open, and its edges are superseded.
    """
    stamp = F.lit(now).cast("timestamp")
    picked = decisions.where(F.col("resolution").isin(*RESOLUTIONS)).select("id", "resolution", "note").dropDuplicates(["id"])
    ruled = state["contradictions"].where("status = 'open'").join(picked, "id")
    fate = F.when(F.col("resolution") == "resolved_a", F.struct(F.col("unit_b_id").alias("id"), F.col("unit_a_id").alias("by"))).when(F.col("resolution") == "resolved_b", F.struct(F.col("unit_a_id").alias("id"), F.col("unit_b_id").alias("by")))
    lost = ruled.select(fate.alias("f")).where("f IS NOT NULL").groupBy(F.col("f.id").alias("id")).agg(F.min("f.by").alias("_by"))
    marked = state["contradictions"].join(ruled.select("id", "resolution", "note"), "id", "left")
    change = lambda c, v: F.when(F.col("resolution").isNotNull(), v).otherwise(F.col(c)).alias(c)
    new = {"status": F.col("resolution"), "resolved_at": stamp, "updated_at": stamp, "resolved_by": F.lit(actor), "resolution_note": F.col("note")}
    contradictions = marked.select(*[change(c, new[c]) if c in new else F.col(c) for c in state["contradictions"].columns])
    units = state["atomic_units"].join(lost, "id", "left")
    units = units.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by_unit_id", F.coalesce("_by", "superseded_by_unit_id"))
    units = units.withColumn("valid_to", F.when(F.col("_by").isNotNull(), F.coalesce("valid_to", stamp)).otherwise(F.col("valid_to")))
    units = schema.touched(units, F.col("_by").isNotNull(), now).select(*state["atomic_units"].columns)
    edges = state["relationships"].join(lost.select(F.col("id").alias("atomic_unit_id"), F.lit(True).alias("_lost")), "atomic_unit_id", "left")
    edges = edges.withColumn("status", F.when(F.col("_lost"), "superseded").otherwise(F.col("status"))).select(*state["relationships"].columns)
    audit = _audit(state, ruled, "resolve", actor, F.col("note"), now, F.lit("open"), F.col("resolution"))
    changed = {"contradictions": contradictions, "atomic_units": units, "relationships": edges}
    return state | {name: schema.settled(df) for name, df in changed.items()} | {"contradiction_audit": audit}


def resolve(state: dict[str, DataFrame], id_: str, resolution: str, now, note: str | None = None, actor: str = "local-user") -> dict[str, DataFrame]:
    """CON-13 for one: an unknown resolution, an unknown id and one that is not open are errors."""
    if resolution not in RESOLUTIONS:
        raise BadRequestError(f"resolution must be one of {', '.join(RESOLUTIONS)}")
    status = get_one(state["contradictions"], id_, "contradiction").first().status
    if status != "open":
        raise BadRequestError(f"contradiction is already {status}")
    decision = state["contradictions"].sparkSession.createDataFrame([(id_, resolution, note)], "id string, resolution string, note string")
    return resolve_all(state, decision, now, actor)


def annotate(state: dict[str, DataFrame], id_: str, note: str, now, actor: str = "local-user") -> dict[str, DataFrame]:
    """CON-14: a non-blank note on a contradiction of any status."""
    if not note.strip():
        raise BadRequestError("a note cannot be blank")
    row = get_one(state["contradictions"], id_, "contradiction")
    none = F.lit(None).cast("string")
    return state | {"contradiction_audit": _audit(state, row, "annotate", actor, F.lit(note), now, none, none)}
