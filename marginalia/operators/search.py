"""Filtered exact similarity search.

One query is a projection and a top-k, all in the JVM. A query set whose vectors take up to SHARED bytes
goes to the tasks that scan the rows, each of which keeps its k best per query and emits them at its end.
A larger set is cut into blocks of that size and met with slices of the rows, block by slice, in bounded
groups; the rows are scanned once either way. Rows and queries without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of query vectors that are sent to every task, rows of a slice, queries scored at once, and digits to which scores are compared.
SHARED, SLICE, BLOCK, DIGITS = 32 << 20, 1 << 15, 256, 6


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector scores 0, different lengths raise."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    unit = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0)) * F.coalesce(F.nullif(norm(b), F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(a) == F.size(b), dot / unit).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def metadata_filter(filters: dict[str, object]) -> Column:
    """All keys equal; a null value is met by a missing one."""
    wanted = F.lit(True)
    for key, value in filters.items():
        wanted = wanted & F.col(key).eqNullSafe(F.lit(value))
    return wanted


def search(rows: DataFrame, query: list[float], k: int, filters: dict[str, object] | None = None, vector: str = "vector", ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The ``k`` rows nearest to ``query``, with score; filters come before scoring."""
    chosen = (rows.where(metadata_filter(filters)) if filters else rows).where(F.col(vector).isNotNull())
    score = F.round(cosine(F.col(vector).cast("array<double>"), F.array(*map(F.lit, map(float, query)))), DIGITS)
    return chosen.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(max(k, 0))


def search_all(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "vector", qid: str = "qid", query_vector: str = "query_vector") -> DataFrame:
    """(qid, id, score, rank) of the ``k`` rows nearest to each query; ties go to the smaller id."""
    id_type, q_type = rows.schema[id_col].dataType, queries.schema[qid].dataType
    schema = T.StructType([T.StructField(qid, q_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    shape, spark = to_arrow_schema(schema), rows.sparkSession
    if k <= 0:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    data = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(query_vector).cast("array<double>").alias("q"))
    size = asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0)).cast("long") * 8).first()[0]

    def table(best: Best, asks: pa.Array) -> pa.Table:
        owner, ids, scores = best.done()
        return pa.table([asks.take(pa.array(owner)), ids, pa.array(scores)], names=schema.names).cast(shape)

    if size <= SHARED:
        whole = asked.toArrow()  # bounded by SHARED
        asks = whole["qid"].combine_chunks()
        shared = spark.sparkContext.broadcast(_matrix(whole["q"]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(shared.value, k)
            for batch in batches:
                best.meet(batch.column("id"), _matrix(batch.column("v")))
            yield from table(best, asks).to_batches()

        found = data.mapInArrow(scan, schema)
    else:
        blocks, slices = -(-size // SHARED), max(1, -(-data.count() // SLICE))

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            best = Best(_matrix(left["q"]), k)
            if left.num_rows:
                best.meet(right["id"], _matrix(right["v"]))
            return table(best, left["qid"].combine_chunks())

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = asked.select("qid", "q", F.pmod(F.xxhash64("qid", "q"), F.lit(blocks)).cast("int").alias("block"), every(slices).alias("slice"))
        data = data.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int").alias("slice"), every(blocks).alias("block"))
        found = asked.groupBy("block", "slice").cogroup(data.groupBy("block", "slice")).applyInArrow(solve, schema)
    order = Window.partitionBy(qid).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best rows met so far for each query."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = _unit(queries), k
        self.owner, self.ids, self.scores = [], [], []
        self.held = 0

    def meet(self, ids: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> None:
        if not len(rows) or not len(self.queries):
            return
        if rows.shape[1] != self.queries.shape[1]:
            raise ValueError("vectors of different dimensions")
        ids, x = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, _unit(rows)
        order = pc.sort_indices(ids).to_numpy()  # rows by id, so that of equal scores the first is the smaller id
        ids, x = ids.take(pa.array(order)), x[order]
        for lo in range(0, len(self.queries), BLOCK):
            scores = np.round(self.queries[lo : lo + BLOCK] @ x.T, DIGITS)
            if len(x) > self.k:
                kth = np.partition(scores, len(x) - self.k, axis=1)[:, len(x) - self.k, None]
                above, at = (scores > kth), (scores == kth)
                room = self.k - above.sum(axis=1, keepdims=True)
                good = above | at & (np.cumsum(at, axis=1) <= room)
            else:
                good = np.ones_like(scores, bool)
            owner, place = np.nonzero(good)
            self.owner.append(owner + lo)
            self.ids.append(ids.take(pa.array(place)))
            self.scores.append(scores[owner, place])
            self.held += len(owner)
        if self.held > 4 * self.k * len(self.queries):
            self.done()

    def done(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Query number, id and score of the best, the rest let go."""
        if not self.owner:
            return np.zeros(0, np.int64), pa.array([], pa.null()), np.zeros(0)
        held = pa.table({"owner": np.concatenate(self.owner), "id": pa.concat_arrays(self.ids), "score": np.concatenate(self.scores)})
        held = held.sort_by([("owner", "ascending"), ("score", "descending"), ("id", "ascending")])
        owner = held["owner"].to_numpy()
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        held = held.filter(pa.array(place < self.k))
        found = held["owner"].to_numpy(), held["id"].combine_chunks(), held["score"].to_numpy()
        self.owner, self.ids, self.scores, self.held = [found[0]], [found[1]], [found[2]], len(found[0])
        return found


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; of one dimension, or it raises."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(np.unique(lengths)) > 1:
        raise ValueError("vectors of different dimensions")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), int(lengths[0]) if len(lengths) else 0)


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1, lengths)
