"""The polling workers as structured streams (STR-01..09)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lorekeep.functions import text as X
from lorekeep.operators.extract import extract_units, persist_units
from lorekeep.operators.scan import scan
from lorekeep.plans import store

CHUNK = "anchor string, anchor_id string, artifact_id string, text string, role string, source_time timestamp, ocr_confidence double"


def chunk_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """STR-01, SRT-10: chunks from files that land in a folder, so many files a batch."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def unit_stream(chunks: DataFrame) -> DataFrame:
    """The rules over a stream of chunks: stateless, so a unit appears as soon as its chunk does."""
    return extract_units(chunks).withColumn("statement_hash", X.sha256_hex(X.normalize_statement("statement")))


def once_per_key(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """STR-05, STR-08: a batch writer that appends rows whose key the target lacks; each batch has a folder of its own
    that a repeated batch overwrites, so replays neither lose nor double rows. The horizon is unbounded."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{target}/batch={number}"
        first = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            before = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(target).where(F.col("batch") < number)
            first = first.join(before.select(key), key, "left_anti")
        first.select(*batch.columns).write.mode("overwrite").parquet(own)

    return write


def into_state(target: str, now: datetime | None = None) -> Callable[[DataFrame, int], None]:
    """STR-05: a batch writer that adds a batch's units, provenance, entities and edges to the stored state.

    All of a batch becomes visible by one pointer swap, and ids come from natural keys, so a batch that is repeated after
    a crash adds nothing. Each version stores only the rows that are new.
    """
    def write(batch: DataFrame, number: int) -> None:
        state = store.load(batch.sparkSession, target)
        state, _ = persist_units(state, extract_units(batch), now or datetime.now(timezone.utc))
        store.save(state, target)

    return write


def run_extraction(spark: SparkSession, folder: str, target: str, checkpoint: str, interval: str | None = None, now: datetime | None = None, files_per_trigger: int = 8) -> StreamingQuery:
    """STR-01, STR-03, STR-06, MUT-09: new chunks into the stored state. The checkpoint is the cursor, and what a crash
    left half done is done again. interval None: what is there now, then stop."""
    writer = chunk_stream(spark, folder, files_per_trigger).writeStream.foreachBatch(into_state(target, now)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def run_scan(folder: str, spark: SparkSession, now: datetime | None = None) -> DataFrame:
    """STR-02, STR-04: one scan over the stored state, written as its next version; returns what it found.

    Merges clear the cursor of the units they touch, so those are scanned again.
    """
    state, found = scan(store.load(spark, folder), now or datetime.now(timezone.utc))
    found = store.checkpointed(found)
    store.save(state, folder)
    return found


def rate_stream(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """STR-09: the tumbling counts of report.rates() over a stream; events later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
