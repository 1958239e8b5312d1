"""Shared pieces: the scratch folder, written tables, shards by key ranges and connected components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, as they do from an installed one, and bound the batches they get.

    Spark's default of 10,000 rows a batch is kept only by sessions that set it; whole texts need smaller batches.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def free_name(name: str, *tables: DataFrame) -> str:
    """name, with underscores before it until no table has such a column in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where that is unset and all tasks run
    in this process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(spark, "_lorekeep_scratch"):
            spark._lorekeep_scratch = f"file://{tempfile.mkdtemp(prefix='lorekeep-')}"
        base = spark._lorekeep_scratch
    return base


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the scratch folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lorekeep/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete written() tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A table of shard starts goes to all tasks up to this many starts of 8 bytes, and is joined by a shuffle beyond.
BROADCAST_STARTS = 1_000_000


def range_shards(docs: DataFrame, key: str, rows_per_shard: int = 8192) -> tuple[DataFrame, int, int]:
    """(docs with _shard, _starts and _before, count of shards at most, the last shard): shards of about rows_per_shard rows
    in ascending order of an integer key.

    _shard (long) rises with the key; nulls are in the first one. _starts says whether the key is the least one of its
    shard, and _before is then the shard before. Starts are values of the column, found over all rows in two levels of
    about the square root of the count of shards each: the coarse ones are all that reaches the driver, the fine ones
    stay a table. An empty or all-null table has one shard.
    """
    spark = docs.sparkSession
    n = docs.select(F.count(key)).first()[0]
    k = max(1, math.isqrt(max(shuffle_partitions(spark), -(-n // rows_per_shard)) - 1) + 1)
    at, accuracy = [i / k for i in range(1, k)], F.lit(max(10_000, 20 * k))
    coarse = sorted(set(docs.select(F.percentile_approx(key, at, accuracy)).first()[0] or [])) if at and n else []
    long = "bigint"
    known = F.array(*[F.lit(x).cast(long) for x in coarse]) if coarse else F.array().cast(f"array<{long}>")
    part = F.coalesce(F.size(F.filter(known, lambda x: x <= F.col(key))), F.lit(0))
    first = F.get(known, F.col("_part") - 1)
    nothing = F.array().cast(f"array<{long}>")
    if at and n:
        found = docs.where(F.col(key).isNotNull()).select(part.alias("_part"), F.col(key).cast(long).alias("_k")).groupBy("_part").agg(F.percentile_approx("_k", at, accuracy).alias("f"), F.min("_k").alias("least"))
        fine = found.select("_part", F.array_sort(F.array_distinct(F.filter("f", lambda x: x > F.coalesce(first, F.col("least"))))).alias("_fine"))
    else:
        fine = spark.range(1).select(F.lit(0).alias("_part"), nothing.alias("_fine"))
    fine = written(fine, "shard-starts")
    sizes = fine.select((F.col("_part") + 1).alias("_part"), F.size("_fine").cast(long).alias("_last"))
    fine = fine.join(sizes, "_part", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    total, last = fine.agg(F.sum(F.size("_fine") + 1), F.max(F.col("_part") * (1 << 32) + F.size("_fine"))).first()
    fine = F.broadcast(fine) if (total or 0) <= BROADCAST_STARTS else fine
    rows = docs.withColumn("_part", part).join(fine, "_part", "left").withColumn("_fine", F.coalesce("_fine", nothing))
    at_start = F.coalesce(F.array_contains("_fine", F.col(key).cast(long)) | (F.col(key) == first), F.lit(False))
    index = F.coalesce(F.size(F.filter("_fine", lambda x: x <= F.col(key))), F.lit(0))
    rows = rows.withColumn("_shard", F.col("_part") * (1 << 32) + index).withColumn("_starts", at_start)
    before = F.when(index > 0, F.col("_shard") - 1).otherwise((F.col("_part") - 1) * (1 << 32) + F.coalesce("_last", F.lit(0)))
    rows = rows.withColumn("_before", F.when(F.col("_starts"), before))
    return rows.select(*[quoted(c) for c in docs.columns], "_shard", "_starts", "_before"), (total or 0) + 1, last or 0


def shard_partitions(shards: int) -> int:
    """Tasks for so many shards: one each up to 4096 tasks, eight each beyond, so tasks stay alike as the table grows."""
    return max(1, min(shards, 4096), -(-shards // 8))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, shortens the pointers by doubling, and contracts the edges
    to the roots, until none is left. Neighbour minima are combined before they are shuffled; rounds are written
    tables, so a lost executor repeats one round at most. Self loops and repeated edges change nothing; a null end
    drops its edge; no edges give no rows.
    """
    edges = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name
    )
    done: DataFrame | None = None
    left = edges.where("a <> b")
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("other")).union(left.select("a", "b"))
        up = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), name)
        while True:
            higher = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(up.join(higher, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), name)
            still = jumped.where("moved").limit(1).count()
            drop_written(up)
            up = jumped.select("node", "root")
            up._scratch_path = jumped._scratch_path
            if not still:
                break
        if done is None:
            merged = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            merged = written(done.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(up.join(done, "node", "left_anti")), name)
            drop_written(done)
        ends = up.withColumnRenamed("node", "a").withColumnRenamed("root", "ra")
        tops = up.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
        next_left = written(
            left.join(ends, "a").join(tops, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name
        )
        drop_written(edges)
        if merged is not up:
            drop_written(up)
        edges, left, done = next_left, next_left, merged
    if done is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return done
