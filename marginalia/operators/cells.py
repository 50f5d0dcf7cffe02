"""A persistent vector index: rows by cell, and only the cells read that can hold an answer.

Rows are assigned to the nearest of some centroids by angle. The table is partitioned by cell, and each cell's centroid, radius (the
largest angle of its rows to the centroid) and number of rows are stored beside it. A row of a cell is at least as far
from a query as the angle to the centroid less the radius, so the cosine of that bounds every score in the cell. Cells are
read in order of their bounds: the first ones give a k-th score, and after them only those whose bound reaches it. Results
equal those of a search over all rows; where nothing is clustered all cells are read, as a scan would.

Rows without a vector take no part; zero vectors score 0 and lie in a cell of their own. Centroids come from a sample
of rows by hash, moved by Lloyd rounds whose sums are made in tasks; the driver holds the centroids alone, CELLS at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from copy import copy
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.plans.staging import stage
from marginalia.sources.versions import create_once

from .search import DIGITS, Best, _matrix, _unit, metadata_filter, search

CELLS, ROUNDS, PROBED, SLICE, ASKED = 1024, 4, 4, 1 << 15, 1 << 12
#: A score is rounded; a cell whose bound stays below the k-th score by more than this is of no use.
SLACK = 10.0**-DIGITS
ZERO = -1


def _nearest(unit: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, ZERO for a zero vector, and the angle to its centroid."""
    scores = unit @ centroids.T
    cell = scores.argmax(axis=1)
    angle = np.arccos(np.clip(scores[np.arange(len(unit)), cell], -1, 1))
    zero = ~unit.any(axis=1)
    return np.where(zero, ZERO, cell), np.where(zero, 0, angle)


def build(rows: DataFrame, path: str, id_col: str, vector: str = "vector", cells: int | None = None, rounds: int = ROUNDS) -> CellIndex:
    """Write ``rows`` that have a vector to ``path`` by cell. About the square root of their number of cells, CELLS at most."""
    spark = rows.sparkSession
    rows = stage(rows.where(F.col(vector).isNotNull()).withColumn(vector, F.col(vector).cast("array<double>")), "cells-rows")
    vectors = rows.select(F.col(vector).alias("v"))
    count = rows.count()
    cells = min(cells or max(1, isqrt(count)), CELLS)
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(cells).select(vector).toArrow()  # CELLS rows at most
    centroids = _unit(_matrix(sample[vector]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        for b in batches:
            unit = _unit(_matrix(b.column("v")))
            cell, _ = _nearest(unit, centroids)
            np.add.at(total, cell[cell != ZERO], unit[cell != ZERO])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["cell", "total"])

    for _ in range(rounds if count else 0):
        parts = vectors.mapInArrow(sums, "cell int, total array<double>").select("cell", F.posexplode("total").alias("place", "x"))
        moved = parts.groupBy("cell", "place").agg(F.sum("x").alias("x")).toArrow()  # CELLS rows of one vector each
        new = np.zeros_like(centroids)
        new[moved["cell"].to_numpy(), moved["place"].to_numpy()] = moved["x"].to_numpy()
        centroids = np.where(new.any(axis=1, keepdims=True), _unit(new), centroids)

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("_cell int, _angle double").fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = _nearest(_unit(_matrix(b.column(vector))), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=schema.names)

    placed = stage(rows.mapInArrow(assign, schema), "cells-placed")
    about = placed.groupBy("_cell").agg(F.max("_angle").alias("radius"), F.count("*").alias("rows")).collect()  # a row per cell
    pieces = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for r in about for x in (r["_cell"], -(-r["rows"] // SLICE)))), F.col("_cell")), F.lit(1)) if about else F.lit(1)
    # a cell that holds many rows is written by as many tasks as it has slices
    spread = placed.drop("_angle").repartition("_cell", F.pmod(F.xxhash64(id_col), pieces))
    spread.write.partitionBy("_cell").mode("overwrite").parquet(f"{path}/rows")
    told = {"id": id_col, "vector": vector, "schema": rows.schema.jsonValue(), "cells": [{"cell": r["_cell"], "radius": r["radius"], "rows": r["rows"], "centroid": centroids[r["_cell"]].tolist() if r["_cell"] != ZERO else None} for r in about]}
    if not create_once(spark, f"{path}/cells.json", json.dumps(told)):
        raise FileExistsError(f"{path} holds an index already")
    return CellIndex(spark, path)


class CellIndex:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        told = json.loads("".join(r.value for r in spark.read.text(f"{path}/cells.json", wholetext=True).collect()))
        self.id_col, self.vector, self.schema = told["id"], told["vector"], T.StructType.fromJson(told["schema"])
        some = [c for c in told["cells"] if c["cell"] != ZERO]
        self.counts = {c["cell"]: c["rows"] for c in told["cells"]}
        self.cells = np.array([c["cell"] for c in some], np.int64)
        self.radius = np.array([c["radius"] for c in some])
        self.centroids = np.array([c["centroid"] for c in some]).reshape(len(some), len(some[0]["centroid"]) if some else 0)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of some cells, or all; other cells' folders are not listed for reading."""
        schema = T.StructType([*self.schema.fields, T.StructField("_cell", T.IntegerType())])
        whole = self.spark.read.schema(schema).parquet(f"{self.path}/rows") if self.counts else self.spark.createDataFrame([], schema)
        return whole if cells is None else whole.where(F.col("_cell").isin(list(map(int, cells))))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each query in order of their bounds, and these."""
        unit = _unit(queries)
        numbers = np.concatenate([self.cells, [ZERO] if ZERO in self.counts else []]).astype(np.int64)
        bound = np.zeros((len(unit), len(numbers)))
        if len(self.cells):
            if unit.shape[1] != self.centroids.shape[1]:
                raise ValueError("vectors of different dimensions")
            angle = np.arccos(np.clip(unit @ self.centroids.T, -1, 1)) - self.radius
            bound[:, : len(self.cells)] = np.where(unit.any(axis=1, keepdims=True), np.cos(np.maximum(angle - 1e-7, 0)), 0)  # 1e-7: the error of an angle near 0
        order = np.argsort(-bound, axis=1, kind="stable")
        return numbers[order], np.take_along_axis(bound, order, axis=1)

    def search(self, query: list[float], k: int, filters: dict[str, object] | None = None) -> DataFrame:
        """The ``k`` rows nearest to ``query``, with score, as ``search.search`` over all rows."""
        cells, bounds = (x[0] for x in self.bounds(np.array([query], float)))
        first = search(self.rows(cells[:PROBED]), query, k, filters, self.vector, (self.id_col,)).select("score").collect()  # k rows
        kth = first[-1]["score"] if len(first) >= k > 0 else -np.inf
        needed = cells[bounds >= kth - SLACK]
        return search(self.rows(needed), query, k, filters, self.vector, (self.id_col,)).drop("_cell")

    def search_all(self, queries: DataFrame, k: int, qid: str = "qid", query_vector: str = "query_vector") -> DataFrame:
        """(qid, id, score, rank) of the ``k`` rows nearest to each query, as ``search.search_all`` over all rows."""
        asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(query_vector).cast("array<double>").alias("q"))

        index = copy(self)
        index.spark = None  # tasks need the numbers alone

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, bounds = index.bounds(_matrix(b.column("q")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(bounds.tolist(), pa.list_(pa.float64()))], names=["qid", "q", "cells", "bounds"])

        shape = T.StructType([*asked.schema.fields, *T.StructType.fromDDL("cells array<int>, bounds array<double>").fields])
        asks = stage(asked.mapInArrow(bounded, shape), "cells-asks")
        probed = asks.select("qid", "q", F.explode(F.slice("cells", 1, PROBED)).alias("_cell"))
        found = stage(self._met(probed, k), "cells-probed")
        kth = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        rest = asks.join(kth, "qid", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("kth") - SLACK).otherwise(F.lit(float("-inf"))))
        more = rest.select("qid", "q", "kth", F.explode(F.slice(F.arrays_zip("cells", "bounds"), PROBED + 1, 1 << 30)).alias("c")).where("c.bounds >= kth").select("qid", "q", F.col("c.cells").alias("_cell"))
        best = self._ranked(found.drop("rank").union(self._met(stage(more, "cells-more"), k).drop("rank")), k)
        return best.select(F.col("qid").alias(qid), F.col("id").alias(self.id_col), "score", "rank")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _met(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best (qid, id, score, rank) of the cells that each query is paired with (qid, q, _cell)."""
        used = {r["_cell"]: r["n"] for r in pairs.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
        schema = T.StructType([pairs.schema["qid"], T.StructField("id", self.schema[self.id_col].dataType), T.StructField("score", T.DoubleType())])
        shape = to_arrow_schema(schema)
        if not used or k <= 0:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
        sizes = self.spark.createDataFrame([(c, max(1, -(-self.counts[c] // SLICE)), max(1, -(-n // ASKED))) for c, n in used.items()], "_cell int, slices int, blocks int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = pairs.join(F.broadcast(sizes), "_cell").select("qid", "q", "_cell", F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("block"), every("slices").alias("slice"))  # CELLS rows at most
        data = self.rows(sorted(used)).join(F.broadcast(sizes), "_cell")
        data = data.select(F.col(self.id_col).alias("id"), F.col(self.vector).alias("v"), "_cell", every("blocks").alias("block"), F.pmod(F.xxhash64(self.id_col), "slices").cast("int").alias("slice"))

        def solve(asks: pa.Table, rows: pa.Table) -> pa.Table:
            best = Best(_matrix(asks["q"]), k)
            if asks.num_rows:
                best.meet(rows["id"], _matrix(rows["v"]))
            owner, ids, scores = best.done()
            return pa.table([asks["qid"].combine_chunks().take(pa.array(owner)), ids, pa.array(scores)], names=schema.names).cast(shape)

        keys = ("_cell", "block", "slice")
        return self._ranked(left.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, schema), k)
