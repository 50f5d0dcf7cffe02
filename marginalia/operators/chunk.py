"""Chunking of documents, as a generated row per chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.markdown import header_chunks

from . import embed
from .search import cosine

SIZE, OVERLAP = 1200, 150
HELD_CHARS = 1 << 22


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` before the last one's end, stripped; blank ones go.

    Windows begin at every step while there is text, so the last may lie inside the one before. start_char and
    end_char are the window's, before stripping. Indexes are counted within the row, without a shuffle.
    """
    step = max(1, size - overlap)
    length = F.length(text)
    cut = F.transform(
        F.sequence(F.lit(0), length - 1, F.lit(step)),
        lambda s: F.struct(s.alias("start"), F.least(length, s + size).alias("end"), tx.strip(F.substring(F.col(text), s + 1, F.lit(size))).alias("text")),
    )
    whole = F.when((length > 0) & ~tx.is_blank(text), F.filter(cut, lambda c: c["text"] != ""))
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), *keep, F.posexplode(whole).alias("chunk_index", "c"))
    named = tx.chunk_id("doc_id", "fixed", "chunk_index", "c.start", "c.end").alias("chunk_id")
    return rows.select(named, "doc_id", "chunk_index", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), F.col("c.text").alias("text"), *keep)


def in_sections(text: str | None, size: int, overlap: int) -> Iterator[dict]:
    """The header-aware chunks of one text, with the number of their section."""
    section = -1
    for c in header_chunks(text or "", size, overlap):
        section += c["chunk_idx"] == 0
        yield {"section": section, **c}


def by_headers(docs: DataFrame, size: int = SIZE, overlap: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections by heading, cut by paragraphs, lines and words; chunk_idx and chunk_total count within a section. A null text has no chunks."""
    schema = "doc_id string, section int, section_heading string, chunk_idx int, chunk_total int, text string"
    columns = ["doc_id", "section", "section_heading", "chunk_idx", "chunk_total", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for i, t in zip(frame["doc_id"], frame["text"], strict=True):
                rows += ({"doc_id": i, **c} for c in in_sections(t, size, overlap))
                held += len(t or "")
                if held > HELD_CHARS:  # chunks are passed on before the batch is done
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ord``: their place by document and index, for ties."""
    return chunks.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1)


SENTENCE_END = f"([.!?]){tx.WS_CLASS}+"
PERCENTILE = 0.95


def semantic(docs: DataFrame, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, percentile: float = PERCENTILE, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences put together while neighbours are alike: doc_id, chunk_index, text, sentences.

    Sentences end at ``.``, ``!`` or ``?`` before white space; longer ones than ``size`` are cut. Each gets a vector by ``embedder`` (a column
    ``vector`` from ``text``), and its distance to the one before is 1 - cosine, to six digits. A chunk ends where the distance is above
    the ``percentile`` of its document's distances, and once ``size`` characters have begun to be full: the sentences that start within
    each ``size`` characters since the last such end belong together, so none has 2 * ``size`` or more. A repeated doc_id makes documents of
    their own; null and blank texts have no chunks.
    """
    split = F.split(F.regexp_replace(text, SENTENCE_END, "$1\x01"), "\x01", -1)
    windows = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(size)), lambda at: F.substring(s, at + 1, F.lit(size)))
    pieces = F.filter(F.transform(F.flatten(F.transform(split, windows)), tx.strip), lambda s: s != "")
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("doc_id"), pieces.alias("pieces"))
    rows = cut.select("row", "doc_id", F.posexplode("pieces").alias("n", "text"))
    order = Window.partitionBy("row").orderBy("n")
    with_vectors = embedder(rows).withColumn("before", F.lag("vector").over(order))
    apart = with_vectors.withColumn("apart", F.when(F.col("before").isNotNull(), F.round(1 - cosine(F.col("before"), F.col("vector")), 6))).drop("vector", "before")
    whole = Window.partitionBy("row")
    cut = apart.withColumn("most", F.percentile("apart", percentile).over(whole))
    cut = cut.withColumn("segment", F.sum(F.when(F.col("apart") > F.col("most"), 1).otherwise(0)).over(order))
    before = Window.partitionBy("row", "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("part", F.floor(F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / size))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), " ")
    found = cut.groupBy("row", "doc_id", "segment", "part").agg(said.alias("text"), F.count("*").alias("sentences"), F.min("n").alias("n"))
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text", "sentences")
