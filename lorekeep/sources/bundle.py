"""Bundles: all tables as JSON lines, out and in (SRC-25..27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators.listing import BadRequestError
from lorekeep.plans import schema
from lorekeep.plans.store import appended

FORMAT = "lorekeep-bundle-v1"
STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def export(state: dict[str, DataFrame], now) -> DataFrame:
    """SRC-25, FN-31: (part, id, value): a manifest line, then a line per row, tables in dependency order.

    Ordering by (part, id) makes equal states equal bundles; writing needs no single task: parts sort as file names.
    """
    spark = next(iter(state.values())).sparkSession
    head = spark.createDataFrame([(FORMAT, list(schema.TABLES))], "format string, tables array<string>").withColumn("exported_at", F.lit(now).cast("timestamp"))
    out = head.select(F.lit(0).alias("part"), F.lit("").alias("id"), F.to_json(F.struct(F.lit("manifest").alias("type"), F.struct("format", "exported_at", "tables").alias("row")), STAMPS).alias("value"))
    for i, table in enumerate(schema.TABLES, 1):
        df = schema.conform(state[table], table)
        out = out.unionByName(df.select(F.lit(i).alias("part"), "id", F.to_json(F.struct(F.lit(table).alias("type"), F.struct(*df.columns).alias("row")), STAMPS).alias("value")))
    return out


def write(state: dict[str, DataFrame], path: str, now) -> None:
    export(state, now).orderBy("part", "id").select("value").write.text(path)


def _typed(lines: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(lines with their type, rows by type); no or two manifests and unknown types are errors."""
    typed = lines.where(F.trim("value") != "").select("value", F.get_json_object("value", "$.type").alias("type"))
    kinds = {r["type"]: r["count"] for r in typed.groupBy("type").count().collect()}  # a row per type
    if kinds.get("manifest") != 1:
        raise BadRequestError("a bundle needs one manifest line")
    if unknown := [k for k in kinds if k != "manifest" and k not in schema.TABLES]:
        raise BadRequestError(f"unknown row type {unknown[0]!r}")
    return typed, kinds


def _table(typed: DataFrame, kinds: dict[str, int], table: str) -> DataFrame:
    """A table of the lines. A table without lines reads none, and a line is parsed only where its type can be the table's."""
    form = T.StructType([T.StructField("row", T._parse_datatype_string(schema.TABLES[table]))])
    if table not in kinds:
        return typed.sparkSession.createDataFrame([], form["row"].dataType)
    named = F.col("value").contains(f'"{table}"') | F.col("value").contains("\\u")  # a name may be written in escapes
    return typed.where(named & (F.col("type") == table)).select(F.from_json("value", form, STAMPS)["row"].alias("r")).select("r.*")


def read_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of a bundle's lines, in whatever order they stand; no or two manifests and unknown types are errors."""
    typed, kinds = _typed(lines)
    return {table: _table(typed, kinds, table) for table in schema.TABLES}


def load(state: dict[str, DataFrame], lines: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC-26, AGG-12, MUT-08: (state with the rows it lacked, (table_name, in_bundle, inserted) for each table).

    Loading again inserts nothing. A row is there already if its id or the table's unique key is. Only tables with lines
    are worked on, and what the state has is left out before rows are compared with each other.
    """
    (typed, kinds), counts, new = _typed(lines), [], state | {}
    for table in schema.TABLES:
        inserted = 0
        if table in kinds:
            key = schema.UNIQUE.get(table)
            fresh = _table(typed, kinds, table).join(state[table].select("id"), "id", "left_anti")
            if key:
                fresh = fresh.join(state[table].select(*key), list(key), "left_anti")
            fresh = schema.settled(fresh.dropDuplicates(["id"]).select(*state[table].columns))
            new[table], inserted = appended(state[table], fresh), fresh.count()
        counts.append((table, kinds.get(table, 0), inserted))
    return new, typed.sparkSession.createDataFrame(counts, "table_name string, in_bundle bigint, inserted bigint")


def in_chunks(data: bytes, size: int = 64 * 1024) -> list[bytes]:
    """SRC-27: a bundle's bytes as the pieces a streaming transport sends."""
    return [data[i : i + size] for i in range(0, len(data), size)]
