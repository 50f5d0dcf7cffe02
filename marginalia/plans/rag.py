"""Composed plans: build an index, retrieve, select by profile, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import chunk, context, embed, search, select

from .config import RetrievalConfig


def index(docs: DataFrame, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of all documents with their vectors."""
    return embedder(chunk.fixed(docs, size, overlap, keep=keep))


def retrieve(rows: DataFrame, queries: DataFrame, k: int, embedder: Callable[[DataFrame], DataFrame] = embed.dummy) -> DataFrame:
    """``queries`` (qid, query) against an index: qid, query, rank, score and the chunks' columns.

    Only ids and vectors go through the search; the texts are joined to the k winners.
    """
    asked = embedder(queries.select("qid", "query", F.col("query").alias("text"))).select("qid", "query", F.col("vector").alias("query_vector"))
    best = search.search_all(rows, asked, k, "chunk_id")
    return best.join(rows.drop("vector"), "chunk_id").join(queries.select("qid", "query"), "qid")


def rag_answer(rows: DataFrame, queries: DataFrame, k: int = 10, budget: int = 1800, max_chunks: int = 10, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, generate: Callable[[str, str], str] = context.extractive) -> DataFrame:
    """An answer per query: retrieved, packed, rendered, generated. A query without evidence gets an empty context."""
    return answered(context.pack(retrieve(rows, queries, k, embedder), budget, max_chunks), queries, generate)


def answered(packed: DataFrame, queries: DataFrame, generate: Callable[[str, str], str] = context.extractive) -> DataFrame:
    """An answer per query from its packed chunks."""
    rendered = queries.select("qid", "query").join(context.render(packed), "qid", "left")
    empty = "\n".join(context.RENDER_HEAD).strip() + "\n"
    return context.answer(rendered.withColumn("rendered_context", F.coalesce("rendered_context", F.lit(empty))), generate)


def by_profile(rows: DataFrame, queries: DataFrame, config: RetrievalConfig, replies: DataFrame | None = None, node_id: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(retrieved, selected) nodes of each query under ``config``.

    ``rows``: node_id, vector, source_path, is_ai, classification, ...; ``queries``: qid, query_vector. Filters come first;
    then score order, best row per source, diversity order, the model's ``replies`` (qid, reply), and the first context_k.
    """
    chosen = rows
    if config.ai_only:
        chosen = chosen.where(F.col("is_ai"))
    if not config.include_moc:
        chosen = chosen.where(F.col("classification") == "note")
    best = search.search_all(chosen, queries, config.retrieve_k, node_id)
    raw = best.join(chosen, node_id)
    now = select.dedupe_by_source(raw, node_id=node_id, ties=(node_id,)) if config.dedupe else raw
    now = select.ranked(now, ties=(node_id,))
    if config.mmr:
        order = select.mmr(now.join(queries.select("qid", "query_vector"), "qid"), config.retrieve_k, config.mmr_lambda, node_id=node_id)
        now = now.drop("ord").join(order.withColumnRenamed("mmr_rank", "ord"), ["qid", node_id])
    if config.rerank and replies is not None:
        now = select.apply_rerank(now.where(F.col("ord") <= config.rerank_candidates), replies, config.context_k)
        now = now.withColumn("ord", F.col("rerank_rank")).drop("rerank_rank")
    return raw, now.where(F.col("ord") <= config.context_k)
