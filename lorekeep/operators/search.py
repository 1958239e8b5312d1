"""Vector and full-text search (SEA-01..08): one plan each, ending in a top-k."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import fulltext as S
from lorekeep.functions import text as X
from lorekeep.operators.listing import BadRequestError, clamp
from lorekeep.plans.store import checkpointed

ANALYSED = "analysed"
SCOPES = ("atomic_units", "messages", "document_segments")


def vector_top_k(rows: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id_: str = "id") -> DataFrame:
    """SEA-02, SEA-03, SRT-06: the k rows of highest cosine with the query, ties by id; unlike sizes and zeros are out.

    Each task keeps its own k best, so k rows a task are shuffled and not the table.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", F.round(X.cosine(F.col(vector), q), 6)).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), id_).limit(k)


def indexed(rows: DataFrame, text: str = "content", stemmed: bool = True) -> DataFrame:
    """rows as a stored table with analysed, the stems of the text: what a generated column of a search engine holds.

    Without stemmed, its words as they stand, for texts that are not English: a query's stems then match those words only.
    """
    return checkpointed(rows.withColumn(ANALYSED, S.analysed(F.col(text), stemmed)))


def text_hits(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """FLT-11: the rows that match, with their score; rows of indexed() are not analysed again."""
    doc = rows if ANALYSED in rows.columns else rows.withColumn(ANALYSED, S.analysed(F.col(text)))
    return doc.where(S.matches(F.col(ANALYSED), query)).withColumn("score", S.rank(F.col(ANALYSED), query)).drop(ANALYSED)


def text_top_k(rows: DataFrame, query: str, k: int, text: str = "content", id_: str = "id") -> DataFrame:
    """SEA-04..06, SRT-07: the k best of the rows that match, ties by id."""
    return text_hits(rows, query, text).orderBy(F.desc("score"), id_).limit(k)


def pivot_top_k(rows: DataFrame, pivots: DataFrame, query: Sequence[float], k: int, cells: int, vector: str = "embedding", id_: str = "id") -> DataFrame:
    """SEA-08: vector_top_k() among the rows of the cells nearest to the query, for rows of pivot_index(): approximate,
    as fewer cells are read; all cells give the exact answer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = pivots.withColumn("_c", X.cosine(F.col("centre"), q)).orderBy(F.desc("_c"), "cell").limit(cells)
    wanted = [r.cell for r in near.select("cell").collect()]  # as many as asked for
    return vector_top_k(rows.where(F.col("cell").isin(wanted)), query, k, vector, id_)


def pivot_index(rows: DataFrame, pivots: int = 64, vector: str = "embedding", id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(stored rows with the cell of their nearest pivot, pivots (cell, centre)): an inverted-file index of unit vectors.

    Pivots are the rows of least hash, a documented sample; every row is indexed, in files by cell, and rows without a
    direction are in no cell.
    """
    known = rows.where(F.coalesce(X.norm(F.col(vector)) > 0, F.lit(False)))
    order = [F.xxhash64(id_), F.col(id_)]
    chosen = known.orderBy(*order).limit(pivots).select(F.col(vector).cast("array<double>").alias("centre"), F.row_number().over(Window.orderBy(*order)).alias("cell"))
    chosen = checkpointed(chosen.select("cell", "centre"))
    all_ = chosen.agg(F.array_sort(F.collect_list(F.struct("cell", "centre"))).alias("_p")).first()._p  # pivots rows, a bound
    best = F.array_max(F.array(*[F.struct(F.coalesce(X.cosine(F.col(vector), F.array(*[F.lit(x) for x in p.centre])), F.lit(-2.0)).alias("c"), F.lit(-p.cell).alias("cell")) for p in all_])) if all_ else None
    dealt = known.withColumn("cell", -best["cell"] if best is not None else F.lit(None).cast("int"))
    return checkpointed(dealt.repartitionByRange("cell", id_).sortWithinPartitions("cell", id_)), chosen


def _parents(state: dict[str, DataFrame], scope: str) -> DataFrame:
    """(id, artifact_id): JOIN-06, and JOIN-18 made deterministic: of a unit's provenance rows the least by id."""
    if scope == "atomic_units":
        return state["atomic_unit_provenance"].groupBy(F.col("atomic_unit_id").alias("id")).agg(F.min_by("artifact_id", "id").alias("artifact_id"))
    if scope == "messages":
        return state["messages"].select("id", "conversation_id").join(state["conversations"].select(F.col("id").alias("conversation_id"), "artifact_id"), "conversation_id").select("id", "artifact_id")
    return state["document_segments"].select("id", "document_id").join(state["documents"].select(F.col("id").alias("document_id"), "artifact_id"), "document_id").select("id", "artifact_id")


def index_texts(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """state whose searchable tables hold their analysed texts; search() then analyses nothing but the query."""
    return state | {scope: indexed(state[scope], "statement" if scope == "atomic_units" else "content") for scope in SCOPES}


def search(state: dict[str, DataFrame], text: str | None = None, embedding: Sequence[float] | None = None, scope: str = "atomic_units", limit: int | None = None, embedder: Callable[[list[str]], list] | None = None, size: int = 768) -> DataFrame:
    """SEA-01, SEA-07: (scope, id, content, artifact_id, score). A given embedding wins over text.

    Text is embedded if an embedder is there and the scope has vectors; if that fails or gives another size, full text
    is searched. Neither text nor embedding, an embedding for messages, another size and an unknown scope are errors.
    """
    if scope not in SCOPES:
        raise BadRequestError(f"scope must be one of {', '.join(SCOPES)}")
    given = embedding is not None
    if not given and text and embedder and scope != "messages":
        try:
            answer = embedder([text])[0]
            embedding = answer if len(answer) == size else None
        except Exception:  # noqa: BLE001  any failure of an outside service means full text
            embedding = None
    if embedding is None and not (text or "").strip():
        raise BadRequestError("text or embedding is needed")
    if embedding is not None and scope == "messages":
        raise BadRequestError("messages have no embeddings")
    if embedding is not None and len(embedding) != size:
        raise BadRequestError(f"the embedding must have {size} components")
    rows, content = state[scope], "content"
    if scope == "atomic_units":
        rows, content = rows.where("status = 'active'"), "statement"
    k = clamp(limit, 20, 1, 100)
    top = vector_top_k(rows, embedding, k) if embedding is not None else text_top_k(rows, text, k, content)
    hits = top.select(F.lit(scope).alias("scope"), "id", F.col(content).alias("content"), "score")
    parents = _parents(state, scope).join(F.broadcast(hits.select("id")), "id", "left_semi")
    return hits.join(parents, "id", "left").select("scope", "id", "content", "artifact_id", "score").orderBy(F.desc("score"), "id")
