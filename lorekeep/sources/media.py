"""PDFs, images and OCR (SRC-18..23) behind injected extractors: none of their libraries is needed to import this."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.workers import reachable
from lorekeep.operators.extract import segments
from lorekeep.plans import schema

#: Below so many bytes of text a page a PDF holds scans, which wait for OCR.
SCANNED_BYTES = 50
# File extensions by media type, for tools that want a named file.
SUFFIX = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/tiff": "tiff", "image/heic": "heic", "image/heif": "heif"}


def suffix_for(media_type: Column) -> Column:
    """SRC-21."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), media_type), F.lit("png"))


def parse_ocr_tsv(lines: DataFrame) -> DataFrame:
    """SRC-20, AGG-09: (image_id, n, value) lines of OCR tables to (image_id, ocr_text, ocr_confidence).

    Level 5 rows with text are words; words of one (page, block, paragraph, line) make a line, in order; confidence is
    the words' mean over 100.
    """
    c = F.split("value", "\t")
    cell = lambda i: F.get(c, F.lit(i))
    words = lines.where((cell(0) == "5") & (F.trim(cell(11)) != "")).select("image_id", "n", *[cell(i).cast("int").alias(f"l{i}") for i in (1, 2, 3, 4)], cell(10).cast("double").alias("conf"), F.trim(cell(11)).alias("word"))
    place = ["l1", "l2", "l3", "l4"]
    joined = words.groupBy("image_id", *place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), " ").alias("line"), F.sum("conf").alias("conf"), F.count("*").alias("k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "line"))), lambda x: x["line"]), "\n")
    return joined.groupBy("image_id").agg(text.alias("ocr_text"), F.round(F.sum("conf") / F.sum("k") / 100, 6).alias("ocr_confidence"))


def _applied(rows: DataFrame, fn: Callable[[bytes], dict], out: str) -> DataFrame:
    """rows with column r, a struct of the type given; a failing call leaves only r.error."""
    reachable()

    @F.pandas_udf(out)
    def run(contents: pd.Series) -> pd.DataFrame:
        made = []
        for content in contents:
            try:
                made.append({"error": None, **fn(bytes(content))})
            except Exception as e:  # noqa: BLE001  one bad file must not fail the others
                made.append({"error": f"{type(e).__name__}: {e}"})
        names = [f.split(" ")[0] for f in out.split(", ")]
        return pd.DataFrame([[m.get(n) for n in names] for m in made], columns=names)

    return rows.withColumn("r", run("raw_content"))


def process_pdfs(state: dict[str, DataFrame], extractor: Callable[[bytes], dict]) -> dict[str, DataFrame]:
    """SRC-18, SRC-22: pending PDFs to text and segments; extractor gives {"text", "pages"} or raises.

    Failures are 'failed', files with too little text a page 'skipped'. Hard-wrapped lines are joined before cutting.
    """
    waiting = state["documents"].where("extraction_status = 'pending'").select("id", "artifact_id")
    raw = state["artifacts"].where("kind = 'document_pdf'").select(F.col("id").alias("artifact_id"), "raw_content")
    done = _applied(waiting.join(raw, "artifact_id"), extractor, "error string, text string, pages int").select("id", "r.*")
    done = done.withColumn("text", X.unwrap_hard_lines("text")).withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.octet_length("text") < SCANNED_BYTES * F.greatest("pages", F.lit(1)), "skipped").otherwise("completed"))
    ok = F.col("status") == "completed"
    docs = state["documents"].join(done, "id", "left")
    new = {"extraction_status": F.coalesce("status", "extraction_status"), "page_count": F.coalesce("pages", "page_count"), "extracted_text": F.when(ok, F.col("text")).otherwise(F.col("extracted_text")), "extraction_tool": F.when(ok, "pdf").otherwise(F.col("extraction_tool"))}
    cut = segments(done.where(ok).select(F.col("id").alias("document_id"), "text"), "text").withColumn("id", X.uuid_of("segment", F.col("document_id"), F.col("seq"))).withColumn("content_hash", X.sha256_hex("content"))
    return state | {"documents": docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in state["documents"].columns]), "document_segments": schema.append_new(state["document_segments"], schema.conform(cut, "document_segments"), ["id"])}


def process_images(state: dict[str, DataFrame], analyzer: Callable[[bytes], dict]) -> dict[str, DataFrame]:
    """SRC-19, SRC-23: pending images; analyzer gives {"width", "height", "taken_at", "ocr_tsv"} or raises.

    taken_at is EXIF text (YYYY:MM:DD HH:MM:SS), read as UTC.
    """
    waiting = state["images"].where("ocr_status = 'pending'").select("id", "artifact_id")
    raw = state["artifacts"].select(F.col("id").alias("artifact_id"), "raw_content")
    done = _applied(waiting.join(raw, "artifact_id"), analyzer, "error string, width int, height int, taken_at string, ocr_tsv string").select("id", "r.*")
    words = parse_ocr_tsv(done.where("ocr_tsv IS NOT NULL").select(F.col("id").alias("image_id"), F.posexplode(F.split("ocr_tsv", "\n")).alias("n", "value")))
    done = done.join(words.withColumnRenamed("image_id", "id"), "id", "left")
    new = {c: F.coalesce(f"d.{c}", f"i.{c}") for c in ("width", "height", "ocr_text", "ocr_confidence")}
    new["taken_at"] = F.coalesce(F.try_to_timestamp("d.taken_at", F.lit("yyyy:MM:dd HH:mm:ss")), F.col("i.taken_at"))
    new["ocr_status"] = F.when(F.col("d.error").isNotNull(), "failed").when(F.col("d.id").isNotNull(), "completed").otherwise(F.col("i.ocr_status"))
    rows = state["images"].alias("i").join(done.alias("d"), F.col("i.id") == F.col("d.id"), "left")
    return state | {"images": rows.select(*[new[c].alias(c) if c in new else F.col(f"i.{c}").alias(c) for c in state["images"].columns])}


def artifact_versions(artifacts: DataFrame, rounds: int = 32) -> DataFrame:
    """MUT-04: (id, version): one more than the artifact it supersedes, where that is there; chains by doubling."""
    up = artifacts.select("id", F.col("supersedes_artifact_id").alias("up")).join(artifacts.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up")
    rows = artifacts.select("id").join(up, "id", "left").withColumn("version", F.when(F.col("up").isNull(), 1).otherwise(2))
    for _ in range(rounds):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        far = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), (F.col("version") - 1).alias("_more"))
        rows = schema.settled(rows.join(far, "up", "left").select("id", F.col("_up").alias("up"), (F.col("version") + F.coalesce("_more", F.lit(0))).alias("version")))
    return rows.select("id", "version")
