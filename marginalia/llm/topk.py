"""Exact top-k by inner product, as a Voronoi kNN join.

All vectors are assigned to the nearest of some pivots: sampled rows, the square root of all in number, at
most PIVOTS. Summaries per cell (the pivot, the largest distance of its queries, and the k + 1
smallest distances of its data) give bounds. With q = p + a and x = p' + b,

    q.x >= p.p' - |p||b| - |p'||a| - |a||b|,

so the k + 1 best such values over all summarised data are a score that every query of a
cell can reach whichever row is its own. A second, tighter one comes from the cell itself: its queries meet
about OWN of its rows, picked by hash, and the least k-th score found is reached by all. A row x is
of use to a cell only if p.x + |a||x|, the most that it can score there, reaches the higher of the two.

Cells that lie together form groups of about TILE_QUERIES queries; a row is sent once to each group
that has a cell of use for it, so there are at most as many copies as groups. The rows sent to a group
are counted first and cut into slices of about TILE_ROWS, and its queries go to these slices only. Tiles of
bounded numbers of queries and rows are solved locally and their winners merged; a cell
or vector that holds a large share of all rows is thus spread over many tasks.

Defined results: components are floor(scale * x); vectors that are null or hold null or
non-finite components take no part; shorter vectors count as ended by zeros. A query's own
row is no candidate, but repeats of it are. Components so large that a score may not fit into 64 bits raise. Ties go to the smaller id, null ids last. With
fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import stage

PIVOTS, TILE_QUERIES, TILE_ROWS, OWN, BLOCK = 1024, 4096, 16384, 2048, 128
LEAST_ROWS, LEAST_TILES = 512, 64
LAST = np.iinfo(np.int64).max


def scaled(df: DataFrame, vec_id: str, embedding: str, scale: int, *more: F.Column) -> DataFrame:
    """row, vec_id, v (whole numbers) and ``more`` of the vectors that take part."""
    real = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(embedding), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return df.where(F.col(embedding).isNotNull() & real).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), whole.alias("v"), *more)


def extent(vectors: DataFrame) -> tuple[int, int, int]:
    """Width of the longest vector, number of rows, and the largest size of a component. Scores that 64 bits may not hold raise."""
    width, rows, low, high = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    most = max(-(low or 0), high or 0)
    if width * most**2 >= 1 << 62:
        raise ValueError(f"components of up to {most} over {width} places have inner products that 64 bits do not hold")
    return width, rows, most


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers of each row, ended by zeros up to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; by floats where these hold every sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Cells:
    """Pivots, and what the summaries say of each cell."""

    def __init__(self, pivots: np.ndarray, k: int):
        self.pivots, self.k = pivots.astype(np.float64), k
        self.norms = np.linalg.norm(self.pivots, axis=1)
        self.queries = np.zeros(len(pivots), np.int64)
        self.radius = np.zeros(len(pivots))
        self.reached = np.full(len(pivots), -np.inf)
        self.group, self.order, self.starts, self.parts = np.full(len(pivots), -1), [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance to it."""
        x = v.astype(np.float64)
        best = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), BLOCK):
            best[lo : lo + BLOCK] = np.argmax(x[lo : lo + BLOCK] @ self.pivots.T - self.norms**2 / 2, axis=1)
        return best, np.linalg.norm(x - self.pivots[best], axis=1)

    def bound(self, near: list[list[float]]) -> None:
        """Set the score that each cell's queries reach at least; ``near``: smallest distances by cell."""
        cell = np.repeat(np.arange(len(near)), [len(x) for x in near])
        d = np.array([y for x in near for y in x], float)
        for i in np.flatnonzero(self.queries):
            low = self.pivots[i] @ self.pivots[cell].T - self.norms[i] * d - self.radius[i] * (self.norms[cell] + d)
            if len(low) > self.k:
                self.reached[i] = np.sort(low)[-self.k - 1]

    def wanted(self, v: np.ndarray) -> np.ndarray:
        """Which rows each cell needs, with slack for rounding."""
        x = v.astype(np.float64)
        lengths = np.linalg.norm(x, axis=1)
        most = x @ self.pivots.T + lengths[:, None] * self.radius
        slack = 1e-9 * (1 + lengths[:, None] * (self.norms + self.radius))
        return (most + slack >= self.reached) & (self.queries > 0)

    def grouped(self, most: int) -> None:
        """Form groups of cells with about ``most`` queries, each cell followed by the nearest one that is left."""
        left = np.flatnonzero(self.queries)
        self.group, self.order, number, held = np.full(len(self.norms), -1), [], 0, 0
        at = left[np.argmax(self.norms[left])] if len(left) else None
        while len(left):
            if held and held + self.queries[at] > most:
                number, held = number + 1, 0
            self.group[at], held = number, held + self.queries[at]
            self.order.append(at)
            left = left[left != at]
            if len(left):
                at = left[np.argmin(((self.pivots[left] - self.pivots[at]) ** 2).sum(axis=1))]
        self.starts = np.flatnonzero(np.diff(self.group[self.order], prepend=-1))
        self.parts = -(-np.bincount(self.group[self.order], self.queries[self.order], len(self.starts)).astype(np.int64) // most)

    def sent(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row and group that it is sent to."""
        found = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(v) if len(self.starts) else 0, BLOCK):
            some = np.logical_or.reduceat(self.wanted(v[lo : lo + BLOCK])[:, self.order], self.starts, axis=1)
            found.append(np.argwhere(some) + (lo, 0))
        return tuple(np.concatenate(found).T)


def best_scores(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64)


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for each row whose id ``every`` divides."""
    vectors = stage(scaled(df, vec_id, embedding, scale), "topk-vectors")
    width, rows_all, _ = extent(vectors)
    pivots = min(pivots or max(1, isqrt(rows_all)), PIVOTS)
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(pivots).select("v").toArrow()  # PIVOTS rows at most
    cells = Cells(matrix(sample["v"], width), k)
    ids = vectors.schema["vec_id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, distance = cells.place(matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(distance)], names=[*b.schema.names, "cell", "distance"])

    numbered = vectors.withColumn("salt", F.xxhash64("row"))
    placed = stage(numbered.mapInArrow(assign, T.StructType([*numbered.schema.fields, *T.StructType.fromDDL("cell int, distance double").fields])), "topk-placed")
    asks = F.col("vec_id") % every == 0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and cell: rows, queries, the queries' radius and the k + 1 smallest distances."""
        rows = {}
        for b in batches:
            cell, d, q = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "distance", "asks"))
            order = np.argsort(cell, kind="stable")
            cell, d, q = cell[order], d[order], q[order].astype(bool)
            for lo, hi in pairwise([*np.flatnonzero(np.diff(cell, prepend=-1)), len(cell)]):
                n, m, r, best = rows.get(cell[lo], (0, 0, 0.0, np.zeros(0)))
                mine = d[lo:hi][q[lo:hi]]
                rows[cell[lo]] = (n + hi - lo, m + len(mine), max(r, mine.max(initial=0)), np.sort(np.concatenate([best, d[lo:hi]]))[: k + 1])
        for c, (n, m, r, best) in rows.items():
            yield pa.RecordBatch.from_pylist([{"cell": int(c), "n": int(n), "m": m, "radius": float(r), "best": best.tolist()}], schema=SUMMARY)

    by_task = placed.select("cell", "distance", F.coalesce(asks, F.lit(False)).alias("asks")).mapInArrow(nearest, "cell int, n long, m long, radius double, best array<double>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best")
    summary = by_task.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("radius").alias("radius"), best).collect()  # a row per pivot
    near: list[list[float]] = [[] for _ in cells.norms]
    held = np.zeros(len(near), np.int64)
    for s in summary:
        cells.queries[s.cell], cells.radius[s.cell], near[s.cell], held[s.cell] = s.m, s.radius, s.best, s.n
    cells.bound(near)

    def looked_up(values: np.ndarray, at: str) -> F.Column:
        """The number that ``values`` has at the column ``at``; there are no more values than pivots."""
        return F.element_at(F.array(*map(F.lit, map(int, values if len(values) else [0]))), F.col(at) + 1)

    pieces = -(-cells.queries // TILE_QUERIES)
    some = F.pmod(F.xxhash64("salt"), looked_up(np.maximum(1, held // OWN), "cell")) == 0
    of_cell = placed.where(some & (looked_up(pieces, "cell") > 0)).select("cell", F.explode(F.sequence(F.lit(0), looked_up(pieces, "cell") - 1)).alias("part"), "row", "v")
    in_cell = placed.where(asks).select("cell", F.pmod("salt", looked_up(np.maximum(1, pieces), "cell")).cast("int").alias("part"), "row", "v")

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        least = np.inf if left.num_rows else -np.inf
        if left.num_rows:
            q, x = matrix(left["v"], width), matrix(right["v"], width)
            rows, own = right["row"].to_numpy(), left["row"].to_numpy()
            for lo in range(0, len(q), BLOCK):
                scores = products(q[lo : lo + BLOCK], x).astype(np.float64)
                scores[own[lo : lo + BLOCK, None] == rows] = -np.inf
                least = min(least, best_scores(scores, k).min())
        return pa.table({"cell": pa.array([c.as_py() for c in left["cell"][:1]], pa.int32()), "least": pa.array([least] * min(1, left.num_rows), pa.float64())})

    reached = in_cell.groupBy("cell", "part").cogroup(of_cell.groupBy("cell", "part")).applyInArrow(reach, "cell int, least double")
    for s in reached.groupBy("cell").agg(F.min("least").alias("least")).collect():  # a row per pivot
        cells.reached[s.cell] = max(cells.reached[s.cell], s.least)
    cells.grouped(TILE_QUERIES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.starts), np.int64)
        for b in batches:
            total += np.bincount(cells.sent(matrix(b.column("v"), width))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["group", "n"])

    counted = placed.select("v").mapInArrow(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()  # a row per group, and there are no more of them than pivots
    slices = np.ones(len(cells.starts), np.int64)
    tile_rows = min(TILE_ROWS, max(LEAST_ROWS, rows_all // LEAST_TILES))  # small tables are spread as well
    for s in counted:
        slices[s.group] = max(1, -(-s.n // tile_rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, group = cells.sent(matrix(b.column("v"), width))
            piece = np.mod(b.column("salt").to_numpy()[at], slices[group])
            copies = cells.parts[group]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            at, group, piece = (np.repeat(x, copies) for x in (at, group, piece))
            tile = [pa.array(x, pa.int32()) for x in (group, part, piece)]
            yield pa.RecordBatch.from_arrays([*tile, *(b.column(c).take(pa.array(at)) for c in ("row", "vec_id", "v"))], names=["group", "part", "slice", "row", "vec_id", "v"])

    shape = T.StructType([*T.StructType.fromDDL("group int, part int, slice int, row long").fields, ids, T.StructField("v", T.ArrayType(T.LongType()))])
    data = placed.select("row", "vec_id", "v", "salt").mapInArrow(send, shape)
    queries = placed.where(asks).withColumn("group", looked_up(np.maximum(0, cells.group), "cell"))
    queries = queries.select("group", F.pmod("salt", looked_up(cells.parts, "group")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), looked_up(slices, "group") - 1)).alias("slice"), "row", "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("row", "query_id", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            q, x = matrix(left["v"], width), matrix(right["v"], width)
            rows, own = right["row"].to_numpy(), left["row"].to_numpy()
            named = right["vec_id"].to_pylist()
            order_id = np.array([LAST if i is None else i for i in named], np.int64)
            ask = left["vec_id"].to_pylist()
            for lo in range(0, len(q), BLOCK):
                scores = products(q[lo : lo + BLOCK], x)
                for n, s in enumerate(scores, lo):
                    kth = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else s.min()
                    some = np.flatnonzero((s >= kth) & (rows != own[n]))
                    some = some[np.lexsort((order_id[some], -s[some]))[:k]]
                    out["row"] += [own[n]] * len(some)
                    out["query_id"] += [ask[n]] * len(some)
                    out["vec_id"] += [named[j] for j in some]
                    out["score"] += s[some].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ("group", "part", "slice")
    winners = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return winners.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SUMMARY = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("radius", pa.float64()), ("best", pa.list_(pa.float64()))])
