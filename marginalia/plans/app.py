"""Whole runs in one call: build an index of files with its manifest, ask it, score it, and a demonstration.

An index is a folder: ``chunks`` (Parquet, vectors included), ``manifest`` (JSON).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import chunk, context, embed, evaluate
from marginalia.sources import files, store

from . import rag
from .staging import stage

# The defaults of a build, of a question and of the demonstration.
CHUNK_SIZE, CHUNK_OVERLAP, DIM, EXTENSIONS = 1200, 150, 128, (".md",)
TOP_K, TOKEN_BUDGET, MAX_CHUNKS = 10, 1800, 10
DEMO_TOP_K, DEMO_BUDGET = 8, 1500


def build_index(
    spark: SparkSession, corpus: Iterable[str], folder: str, name: str, recursive: bool = True, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, dim: int = DIM, cache: str | None = None,
    extensions: Iterable[str] = EXTENSIONS, max_docs: int | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None, model: str = "dummy",
) -> DataFrame:
    """Ingest the files of ``corpus``, cut and embed them, write the index to ``folder`` and return its rows.

    With ``cache`` (a Parquet folder) only texts that it lacks are embedded, and it is added to.
    """
    corpus, extensions = list(corpus), list(extensions)
    docs, report = files.load_documents(spark, corpus, extensions, recursive)
    docs = stage(docs if max_docs is None else files.first_documents(docs, max_docs), "index-docs")
    pieces = chunk.fixed(docs, size, overlap, keep=("uri", "title"))
    embedder = embedder or partial(embed.dummy, dim=dim)
    if cache is None:
        rows = embedder(pieces)
    else:
        pieces = stage(pieces, "index-chunks")
        _, fresh = embed.cached(pieces, store.open_cache(spark, cache), embedder, model, dim)
        fresh.write.mode("append").parquet(cache)
        rows, _ = embed.cached(pieces, store.open_cache(spark, cache), embedder, model, dim)
    index = store.IndexTable(spark, f"{folder}/chunks")
    index.save(rows)
    counts = {"documents": docs.count(), "chunks": index.count()}
    about = store.manifest(name, corpus, extensions, recursive, counts, {"size": size, "overlap": overlap}, {"model": model, "dim": dim}, report.first().asDict(recursive=True))
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return index.rows()


def ask(
    rows: DataFrame, questions: DataFrame, top_k: int = TOP_K, budget: int = TOKEN_BUDGET, max_chunks: int = MAX_CHUNKS, embedder: Callable[[DataFrame], DataFrame] = embed.dummy,
    generate: Callable[[str, str], str] = context.extractive,
) -> tuple[DataFrame, DataFrame]:
    """Answers (qid, query, answer, abstained) to ``questions`` (qid, query) against an index's rows, and their citations."""
    packed = stage(context.pack(rag.retrieve(rows, questions, top_k, embedder), budget, max_chunks), "ask-packed")
    return rag.answered(packed, questions, generate), context.citations(packed)


def run_eval(rows: DataFrame, queries: DataFrame, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, top_k: int = 10, ks: tuple[int, ...] = (5, 10)) -> tuple[DataFrame, DataFrame]:
    """Summary and rows per query of an eval set (qid, query, relevant_chunk_ids); see evaluate.details."""
    found = stage(rag.retrieve(rows, queries.select("qid", "query"), top_k, embedder).select("qid", "chunk_id", "rank"), "eval-found")
    relevant = queries.select("qid", F.explode("relevant_chunk_ids").alias("chunk_id"))
    return evaluate.summary(evaluate.per_query(queries, found, relevant, ks, item="chunk_id"), ks), evaluate.details(queries, found)


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A built-in text indexed and asked: answer and citations."""
    said = (
        "Packing puts the best chunks into a budget of tokens. "
        "How often the right chunk is found is measured by recall. "
        "Retrieval quality is evaluated by recall and by the rank of the first hit.\n"
    )
    docs = spark.createDataFrame([("doc_demo_001", said * 25, "demo", "memory://demo", "Demo Doc")], "doc_id string, text string, source string, uri string, title string")
    rows = stage(rag.index(docs.withColumn("text", tx.strip("text")), keep=("uri", "title")), "demo-index")
    question = spark.createDataFrame([("demo", "How is retrieval quality evaluated?")], "qid string, query string")
    return ask(rows, question, DEMO_TOP_K, DEMO_BUDGET)
