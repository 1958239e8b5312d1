"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range is kept.

A shingle is WORDS consecutive words (ASCII white space parts words); a shorter text is one shingle, a wordless text has
none. A word's hash is XXH64, a shingle's is XXH64 chained over its words' hashes, and a sketch is the ascending array of
the distinct hashes below the threshold. As the threshold is the same for all texts, sketches of very unequal texts are
comparable, the sketch of a union is the union of sketches, and containment is estimated without bias. A short text may have an empty
sketch. as_text() therefore has the text's least hash beside the sketch, whatever it is: by it, and by nothing else, two
texts without a sketch are compared.

DataFrame functions only; memory is that of one text's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_shards, shard_partitions

WORDS = 5
FRACTION = 1 / 8
ROWS_PER_SHARD = 4096


def threshold(fraction: float) -> int:
    """Signed hashes below this are the given fraction of all."""
    return min(int(-(2**63) + fraction * 2**64), 2**63 - 1)


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """df with column out, the sketch (array<bigint>) of the text column, and out_least, the least of all its hashes (null
    without a word); null texts count as empty."""
    w, h = f"_{out}_w", f"_{out}_h"
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    df = df.withColumn(w, F.when(spaced == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(spaced, " "), lambda x: F.xxhash64(x))))
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(words)]))
    whole = F.array(F.aggregate(w, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
    df = df.withColumn(h, F.when(F.size(w) == 0, F.col(w)).when(F.size(w) <= words, whole).otherwise(runs))
    low = F.filter(h, lambda x: x < F.lit(threshold(fraction)))
    return df.withColumn(out, F.sort_array(F.array_distinct(low))).withColumn(f"{out}_least", F.array_min(h)).drop(w, h)


def as_text(sketch: str) -> Column:
    """The fingerprint of a with_sketch() column: 16 hexadecimal digits a hash of the sketch, or, without one, ``~`` and the
    least hash; empty without a word."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.when(F.size(sketch) > 0, F.array_join(F.transform(sketch, digits), "")).otherwise(F.coalesce(F.concat(F.lit("~"), digits(F.col(f"{sketch}_least"))), F.lit("")))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two with_sketch() columns; texts without sketches are alike if their least
    hashes are one, which has the probability of their likeness."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.col(f"{a}_least").eqNullSafe(F.col(f"{b}_least")).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(part: str, whole: str) -> Column:
    """Estimated share of part's shingles that whole has, whatever their lengths; an empty part is contained."""
    return F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def merged(a: str, b: str) -> Column:
    """The sketch of both texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def with_next(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) dealt to shards of ascending doc_id, and the window in which lead() sees the next document.

    Each shard also has the first document of the next shard, and the last shard that of the whole table, as rows with
    _copy true: drop them last. So no task sees more than a shard. Null doc_ids come first; equal ones go by text.
    """
    rows, shards, last = range_shards(docs, "doc_id", rows_per_shard)
    first = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    is_first = F.col("doc_id").isNull() if first[1] else F.col("doc_id") == F.lit(first[0])
    copies = lambda at, late, copy: F.struct(at.alias("_shard"), F.lit(late).alias("_late"), F.lit(copy).alias("_copy"))
    nothing = F.array().cast("array<struct<_shard:bigint,_late:int,_copy:boolean>>")
    places = F.concat(
        F.array(copies(F.col("_shard"), 0, False)),
        F.when(F.col("_starts"), F.array(copies(F.col("_before"), 0, True))).otherwise(nothing),
        F.when(F.coalesce(is_first, F.lit(False)), F.array(copies(F.lit(last).cast("bigint"), 1, True))).otherwise(nothing),
    )
    dealt = rows.withColumn("_at", F.explode(places)).select(*docs.columns, "_at.*").repartition(shard_partitions(shards), "_shard")
    order = Window.partitionBy("_shard").orderBy("_late", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt, order


def edited_report(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each document against an edited copy, whose last quarter is the start of the next document, and against the next.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (as_text), near_edited, near_next. A null
    text counts as empty; a single document is its own next; repeated rows follow each other; an empty table gives none.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, order = with_next(plain)
    rows = dealt.withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("_next", F.lit(1), quarter))
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = with_sketch(with_sketch(rows, "text", "_own", words, fraction), "_edited", "_new", words, fraction)
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).drop("_edited").withColumn("_after", F.lead("_own").over(order)).withColumn("_after_least", F.lead("_own_least").over(order))
    return rows.where(~F.col("_copy")).select(
        "doc_id", "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_new").alias("edited_fingerprint"),
        likeness("_own", "_new").alias("near_edited"), likeness("_own", "_after").alias("near_next"),
    )
