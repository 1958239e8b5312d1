"""Language identification by the nearest of several centroids per language.

A text's features are hashed character 1-, 2- and 3-grams of its lower-cased letters (other characters count as one
space), as log-scaled counts times inverse document frequency, at unit length. Each language has up to CENTROIDS
centroids from spherical k-means; the language of the most similar centroid (cosine) is predicted. A text is rejected
if its distance to that centroid is beyond the centroid's own limit, or if it has no letter.

Fitting reads at most about PER_LANGUAGE labelled documents of each language (a bounded sample by hash of doc_id, the
documented parameter per_language); predicting reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted

DIMENSIONS = 8192
CENTROIDS = 4
PER_LANGUAGE = 600
#: Clusters with a smaller share of their language's sample are odd texts and make no centroid.
SMALLEST = 0.05
#: A text is rejected below this share of the lowest cosine that the centroid has among its own sample texts.
SLACK = 0.5
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts by hashed n-gram of the whole text; None where it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint32)
    if not (code != 32).any():
        return None
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    one = code * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (code[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (code[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=dimensions)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, dimensions)
    owner: np.ndarray  # language of each centroid
    limit: np.ndarray  # lowest cosine that each centroid accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language ('und' without a letter), cosine clipped to 0..1, and whether the text is rejected."""
        counts = [grams(t, len(self.idf)) for t in texts]
        known = [i for i, c in enumerate(counts) if c is not None]
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known and len(self.languages):
            x = np.stack([counts[i] for i in known]).astype(np.float32)
            cosine = unit(np.log1p(x, out=x) * self.idf) @ self.centroids.T
            best = cosine.argmax(1)
            for i, b, c in zip(known, best, cosine[np.arange(len(known)), best], strict=True):
                lang[i], score[i], rejected[i] = self.languages[self.owner[b]], float(min(1, max(0, c))), bool(c < self.limit[b])
        return lang, score, rejected


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows, from rows that are evenly spread by their likeness to the mean."""
    order = np.argsort(x @ x.mean(0), kind="stable")
    k = min(k, len(x))
    c = x[order[[int((i + 0.5) * len(x) / k) for i in range(k)]]]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = unit(np.stack([x[of == i].mean(0) if (of == i).any() else c[i] for i in range(len(c))]))
    share = np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)
    return c[share >= min(SMALLEST, share.max())]


def labelled_sample(docs: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, the same ones for the same data, without gathering a label in one task."""
    counts = docs.groupBy(label).count().where(F.col("count") > per_label)  # all rows of other labels stay
    share = counts.select(label, (F.lit(per_label) / F.col("count")).alias("share"))
    position = (F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND((1 << 40) - 1) / float(1 << 40))
    return docs.join(F.broadcast(share), label, "left").where(F.coalesce(position < F.col("share"), F.lit(True)))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, centroids: int = CENTROIDS) -> Model:
    """docs: doc_id, text and lang of the rows to learn from; rows without lang or letters teach nothing.

    At most about per_language rows of each language are gathered, as sparse counts; the driver's memory grows with the
    count of languages.
    """
    prepare(docs.sparkSession)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(y, c) for y, c in zip(b.column(0).to_pylist(), (grams(t, dimensions) for t in b.column(1).to_pylist()), strict=True) if c is not None]
            at = [np.nonzero(c)[0] for _, c in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in rows], pa.string()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([np.minimum(c[a], 2**32 - 1).astype("<u4").tobytes() for a, (_, c) in zip(at, rows, strict=True)], pa.binary())],
                names=["lang", "at", "n"],
            )

    rows = labelled_sample(docs.where("lang IS NOT NULL").select("doc_id", "lang", "text"), "lang", per_language).select("lang", "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(featurize, "lang string, at binary, n binary").collect())  # bounded by per_language
    languages = sorted({r[0] for r in found})
    x = np.zeros((len(found), dimensions), np.float32)
    of = np.array([languages.index(r[0]) for r in found], int)
    for i in range(len(found)):
        _, at, n = found[i]
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        found[i] = None
    idf = (np.log((1 + len(found)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    parts, owner, limit = [], [], []
    for k in range(len(languages)):
        own = x[of == k]
        c = k_means(own, centroids)
        cosine = own @ c.T
        best = cosine.argmax(1)
        parts.append(c)
        owner += [k] * len(c)
        limit += [SLACK * float(cosine[best == j, j].min()) if (best == j).any() else 1.0 for j in range(len(c))]
    return Model(languages, idf, np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, dimensions), np.float32), np.array(owner, int), np.array(limit))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with lang_pred string, lang_score double (0 to 1) and lang_rejected boolean.

    Null texts and texts without a letter: 'und', 0, rejected. The model (a fixed number of centroids) goes to each task.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lang, score, rejected = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names[:-1], "lang_pred", "lang_score", "lang_rejected"])

    return _with(docs, run, "lang_pred string, lang_score double, lang_rejected boolean")


def _with(docs: DataFrame, run, added: str) -> DataFrame:
    """docs with the columns added; columns of docs that have such a name, in any case, are replaced."""
    from pyspark.sql import types as T

    new = T._parse_datatype_string(added)
    names = {n.lower() for n in new.names}
    kept = [f for f in docs.schema if f.name.lower() not in names]
    # Columns have plain names on the way, as names with dots would not be found.
    rows = docs.select(*[F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)], F.col("text").cast("string").alias("text"))
    out = [*(f.name for f in kept), *new.names]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=out)

    return rows.mapInArrow(renamed, T.StructType([*kept, *new.fields]))


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null doc_ids are in no fold."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
