"""Where state lives: versions that list immutable folders, a pointer that is swapped, and tables that cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lorekeep.plans.schema import TABLES

_OWN: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lorekeep-"))
    return _OWN[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a written table: a lost executor does not bring the steps before it back."""
    path = f"{checkpoint_folder(df.sparkSession)}/lorekeep/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class State(dict):
    """Tables by name, with what is stored of them: for each table the frame that was loaded and its folders."""

    def __init__(self, tables: dict[str, DataFrame], stored: dict[str, tuple[DataFrame, list[str]]] | None = None):
        super().__init__(tables)
        self.stored = stored or {}

    def __or__(self, other: dict) -> State:
        return State({**self, **other}, self.stored)


def appended(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """existing and rows; save() stores only the rows where existing is stored already."""
    out = existing.unionByName(rows)
    out._grown_from = [*getattr(existing, "_grown_from", [existing]), rows]
    return out


def _folders(name: str, df: DataFrame, stored: dict, write) -> list[str]:
    base, folders = stored.get(name, (None, []))
    if df is base:
        return folders
    first, *rest = getattr(df, "_grown_from", [None])
    if base is not None and first is base:
        return [*folders, *(write(part) for part in rest)]
    return [write(df)]


def save(state: dict[str, DataFrame], folder: str) -> str:
    """MUT-06: write what changed, then swap the pointer; readers see all of a version or none of it.

    A version lists each table's folders. A table that is as it was loaded keeps its folders, one that only grew by
    appended() gets another folder with the new rows, and any other is written anew. Folders are never overwritten.
    """
    spark = next(iter(state.values())).sparkSession
    version, written = f"v-{uuid.uuid4().hex}", {}

    def write(df: DataFrame) -> str:
        path = f"{version}/part-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{folder}/{path}")
        return path

    for name, df in state.items():
        written[name] = _folders(name, df, getattr(state, "stored", {}), write)
    new, fs = _fs(spark, f"{folder}/CURRENT.{version}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version, "tables": written}).encode()))
    out.close()
    current, _ = _fs(spark, f"{folder}/CURRENT")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, current, overwrite)
    return version


def load(spark: SparkSession, folder: str) -> State:
    """The current version's tables."""
    tables = json.loads(spark.read.text(f"{folder}/CURRENT").first()[0])["tables"]
    read = {name: spark.read.schema(T._parse_datatype_string(ddl)).parquet(*[f"{folder}/{p}" for p in tables[name]]) for name, ddl in TABLES.items()}
    return State(read, {name: (df, tables[name]) for name, df in read.items()})
