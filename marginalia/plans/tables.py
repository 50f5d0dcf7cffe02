"""Table functions for SQL: ``SELECT * FROM pack_context(TABLE(t) PARTITION BY qid ORDER BY score DESC, chunk_id, budget => 1800)``.

``register`` makes them known to a session. Python workers need this package on their path.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marginalia.functions import text as tx
from marginalia.operators import chunk, context


def _table(given: AnalyzeArgument, *needed: str) -> T.StructType:
    """The schema of a table argument that has the columns ``needed``."""
    if not given.isTable:
        raise ValueError("the first argument has to be a table: TABLE(t)")
    if missing := [c for c in needed if c not in given.dataType.names]:
        raise ValueError(f"the table lacks the columns {missing}")
    return given.dataType


class PackContext:
    """The chunks of a partition, in its order, that fit the budget: the table's columns, then rank, cost and used.

    As ``context.pack``, whose order is the caller's ORDER BY here. A partition's rows are read until its pack ends, and no more texts are
    remembered than it may hold. All rows are shuffled, while ``context.pack`` sends each partition's best only: for large tables take that.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument | None = None, max_chunks: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _table(rows, "text")
        if clash := {"rank", "cost", "used"} & {c.lower() for c in schema.names}:
            raise ValueError(f"columns {sorted(clash)} are there already")
        return AnalyzeResult(T.StructType([*schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("used", T.LongType())]))

    def __init__(self) -> None:
        self.seen: set[str | None] = set()
        self.used = context.HEADER_TOKENS

    def eval(self, rows: Row, budget: int = 1800, max_chunks: int = 12) -> Iterator[tuple]:
        text = rows["text"]
        signature = None if text is None else " ".join(text.lower().split())[: tx.SIGNATURE_CHARS]
        if signature in self.seen:
            return
        rank = len(self.seen) + 1
        if rank > max(max_chunks, 1):
            raise SkipRestOfInputTableException("the pack is full")
        self.seen.add(signature)
        cost = max(1, len(f"[{rank}]\n") // 4) + max(1, len(text or "") // 4) + context.BREAK_TOKENS
        self.used += cost
        if self.used > budget:
            raise SkipRestOfInputTableException("the budget is spent")
        yield (*rows, rank, cost, self.used)


class ChunkByHeaders:
    """``chunk.by_headers`` of a table with doc_id and text, a document at a time."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        named = _table(docs, "doc_id", "text")["doc_id"]
        number, words = T.IntegerType(), T.StringType()
        return AnalyzeResult(T.StructType([named]).add("section", number).add("section_heading", words).add("chunk_idx", number).add("chunk_total", number).add("text", words))

    def eval(self, docs: Row, size: int = chunk.SIZE, overlap: int = 200) -> Iterator[tuple]:
        for c in chunk.in_sections(docs["text"], size, overlap):
            yield docs["doc_id"], c["section"], c["section_heading"], c["chunk_idx"], c["chunk_total"], c["text"]


def register(spark: SparkSession) -> None:
    """``pack_context`` and ``chunk_headers`` for this session's SQL."""
    spark.udtf.register("pack_context", udtf(PackContext))
    spark.udtf.register("chunk_headers", udtf(ChunkByHeaders))
