"""Context packing under a token budget, citations, rendering, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx

from .models import with_model

HEADER_TOKENS, BREAK_TOKENS = 2, 1  # estimates of the header and of the blank line after a chunk
# The wording of prompts.
RENDER_HEAD = (
    "You are given CONTEXT chunks from a document corpus. Answer the QUESTION using only the CONTEXT.\n",
    "If the answer is not supported by the CONTEXT, say you don't know.\n",
    "CONTEXT:\n",
)
# How a model is asked; callers may pass a wording of their own.
QUESTION = "{context}\nAnswer from the chunks above and name the numbers of those you used.\n\nQuestion: {query}\n"
NOTES_PROMPT = "Notes:\n{context}\n\nReply to the question below from these notes alone, naming the files you rely on; if they do not say, admit that you don't know.\n\nQuestion: {query}\n"


def pack(rows: DataFrame, budget: int, max_chunks: int = 12, min_score: float | None = None, dedupe: bool = True, include_scores: bool = False, qid: str = "qid", ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The chunks of each query that fit its budget, with rank, cost and used (tokens so far, header included).

    By rerank_score, else score, best first. A text whose signature came before is left out, before the budget is
    looked at. The first chunk over the budget ends the pack; so does max_chunks, but one chunk at least may stand.
    """
    eff = F.coalesce("rerank_score", "score") if "rerank_score" in rows.columns else F.col("score")
    rows = rows.withColumn("eff", eff)
    if min_score is not None:
        rows = rows.where(F.col("eff") >= min_score)
    order = [F.desc("eff"), *map(F.col, ties)]
    if dedupe:
        first = F.row_number().over(Window.partitionBy(qid, tx.signature("text")).orderBy(*order))
        rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    place = Window.partitionBy(qid).orderBy(*order)
    # cut before the running sum, so that a query's partitions send their best rows only
    rows = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= max(max_chunks, 1))
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))
    if include_scores:
        label = F.concat(label, F.lit(" score="), F.format_string("%.4f", "eff"))
    cost = tx.token_estimate(F.concat(label, F.lit("\n"))) + tx.token_estimate("text") + BREAK_TOKENS
    rows = rows.withColumn("cost", cost)
    used = HEADER_TOKENS + F.sum("cost").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def citations(packed: DataFrame, qid: str = "qid") -> DataFrame:
    """Where each packed chunk comes from: ids, uri, quote and whatever headings and offsets the rows have."""
    uris = [F.nullif(F.col(c), F.lit("")) for c in ("uri", "source_uri") if c in packed.columns]
    more = [c for c in ("section_heading", "section_path", "start_char", "end_char") if c in packed.columns]
    return packed.select(qid, "rank", "chunk_id", "doc_id", F.coalesce(*uris, F.lit("")).alias("uri"), tx.quote("text").alias("quote"), *more, F.col("eff").alias("score"))


def render(packed: DataFrame, qid: str = "qid") -> DataFrame:
    """The prompt's context of each query, chunks in rank order with their source."""
    title = F.coalesce("title", F.lit("")) if "title" in packed.columns else F.lit("")
    uri = F.coalesce("uri", F.lit("")) if "uri" in packed.columns else F.lit("")
    source = tx.strip(F.concat(F.lit("Source: "), title, F.lit(" "), uri))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"))
    named = F.when((title != "") | (uri != ""), F.concat(source, F.lit("\n"))).otherwise("")
    block = F.concat(head, named, tx.strip("text"), F.lit("\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    text = F.concat(F.lit("\n".join(RENDER_HEAD) + "\n"), F.array_join(blocks, "\n"))
    return packed.groupBy(qid).agg(F.concat(tx.strip(text), F.lit("\n")).alias("rendered_context"), F.max("used").alias("tokens_used_est"))


def extractive(query: str, context: str) -> str:
    """Offline stand-in for a language model: the sentence that shares most words with the query, or an admission."""
    import re

    wanted = set(re.findall(r"[a-z0-9]+", query.lower()))
    body = context.partition(RENDER_HEAD[2])[2]
    best = max(re.split(r"(?<=[.!?])\s+", body), key=lambda s: len(wanted & set(re.findall(r"[a-z0-9]+", s.lower()))), default="")
    return best.strip() if wanted & set(re.findall(r"[a-z0-9]+", best.lower())) else "I don't know."


def answer(contexts: DataFrame, generate: Callable[[str, str], str] = extractive, qid: str = "qid", error: str | None = None, **limits: float) -> DataFrame:
    """qid, query, answer and abstained. ``generate`` takes a query and its rendered context.

    It is asked one query at a time and again after a failure (``limits`` as in ``models.with_model``). A query that fails in the end has a null answer,
    which abstains from nothing, and its reason in the column ``error``; without such a column it fails the job. A null query or context has a null answer.
    """

    def asked(queries: list[str], texts: list[str]) -> list[str]:
        return [(generate(q, c) or "").strip() for q, c in zip(queries, texts, strict=True)]

    made = with_model(contexts.select(qid, "query", "rendered_context"), asked, "string", ("query", "rendered_context"), "answer", error, items=1, **limits)
    return made.select(qid, "query", "answer", tx.abstained("answer").alias("abstained"), *([error] if error else []))


def prompt(context: Column | str, query: Column | str, template: str = QUESTION) -> Column:
    head, _, rest = template.partition("{context}")
    mid, _, tail = rest.partition("{query}")
    return F.concat(F.lit(head), tx._col(context), F.lit(mid), tx._col(query), F.lit(tail))
