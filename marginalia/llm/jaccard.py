"""Exact Jaccard join of word shingles, as a blocked sparse product of the document by shingle matrix with itself.

Rows of the matrix are distinct shingle sets (equal sets are one row from the start), columns are
shingles, and the product holds the overlap of every two rows. With sizes n and m a pair links at
overlap >= num / (num + den) * (n + m), so at least num / den of a row's own columns have to be met.
Columns are worked off in blocks, and what can no longer reach its bound goes:

* The first block is a part of all columns by hash, HEAD times the share num / den leaves: a fifth at 0.9, two fifths at 0.8. A column that a single row has
  adds nothing to any pair; a row with more of those than its bound leaves goes. This takes out almost
  all texts that are no near copies, and only a part of their shingles is ever shuffled.
* For the rows left the columns of one row are dropped, and rows are bounded again. Of a row's
  columns, rarest first, one of the first c - need + 1 has to be met by any partner, where c
  columns are left and need of them have to be met. Rows that share such a column form candidate classes
  (star rounds); no pair across classes can link.
* A class is multiplied block by block of rows, in tiles of bounded size, rarest columns first: dense
  products of COLUMNS columns each, after which pairs whose overlap plus what is left of the shorter rest
  stays below their bound go. A tile returns no pairs, but a spanning tree of those found.
* A class of more rows than a block is first multiplied with one of its rows, the pivot. One minus the
  Jaccard similarity is a metric, so rows fall into rings of width 1 - num / den around the pivot, and links
  stay within a ring or two adjacent ones. Rows in the innermost ring are linked to the pivot, so they need no
  tiles among themselves: a large group of near copies costs as many products as it has rows. Only a group of
  rows that are alike, but not alike enough, takes a number of tiles that grows as its square over BLOCK * BLOCK.

Defined results: null text counts as empty; texts of fewer words than a shingle are one shingle; texts
without words are linked with nothing. Shingles are told apart by 64 bits of hash, sets by 128. Repeated
rows get a row each. A null id takes no part in a component's smallest id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import settle, stage

from .common import small_batches, text_blocks
from .components import connected_components
from .simhash import shingle_hashes

SHINGLE, LEAST = 3, (9, 10)
HEAD, BLOCK, ENTRIES, COLUMNS = 2, 1024, 1 << 20, 2048


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64)).view(np.int64)


def _head(columns: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Those of the columns that are in the first block: HEAD times as large a part as a row may have to itself."""
    num, den = least
    return columns[columns.view(np.uint64) <= np.uint64(min((1 << 64) - 1, (1 << 64) * HEAD * (den - num) // den))]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sized(texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """row and id of ``texts`` with n, digest (of the set) and head (its columns of the first block)."""
    schema = T.StructType([*(f for f in texts.schema.fields if f.name != "text"), *T.StructType.fromDDL("n long, digest binary, head array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            made = [pa.array([len(s) for s in found], pa.int64()), pa.array(digests, pa.binary()), _lists([_head(s, least) for s in found])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *made], names=schema.names)

    return texts.mapInArrow(run, schema)


def _columns(texts: DataFrame, shingle: int) -> DataFrame:
    """node (the row), n and columns of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in found], pa.int64()), _lists(found)], names=["node", "n", "columns"])

    return texts.select("row", "text").mapInArrow(run, "node long, n long, columns array<long>")


def _reaches(overlap: Column, n: Column, least: tuple[int, int]) -> Column:
    """Whether a row of size ``n`` that shares ``overlap`` columns at most can link with any."""
    return F.lit(least[1]) * overlap >= F.lit(least[0]) * n


def _left(rows: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``row`` of the ``sets`` (digest, row, n) that the first block of columns leaves; ``rows`` (digest, head) are all rows, copies too.

    Only numbers are shuffled, never the lists of columns: a column is alone where the smallest and the largest of its sets, told apart by a
    hash of their digests, are the same.
    """
    key = F.xxhash64("digest")
    met = rows.select(key.alias("key"), F.explode("head").alias("column")).groupBy("column").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    alone = met.where("key = last").groupBy("key").agg(F.count("*").alias("alone"))
    bounded = sets.withColumn("key", key).join(alone, "key", "left").where(_reaches(F.col("n") - F.coalesce("alone", F.lit(0)), F.col("n"), least))
    return bounded.select("row")


def links(texts: DataFrame, left: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (u, v) that join the rows in ``left`` (row: one per set) as all pairs of a similarity of ``least`` do, given ``texts`` (row, text)."""
    full = stage(_columns(texts.join(left, "row", "left_semi"), shingle), "jaccard-columns")

    entries = full.select("node", "n", F.explode("columns").alias("column"))
    shared = stage(entries.groupBy("column").agg(F.count("*").alias("rows")).where("rows > 1"), "jaccard-shared")
    ordered = F.sort_array(F.collect_list(F.struct("rows", "column")))
    rare = entries.join(shared, "column").groupBy("node", "n").agg(ordered.alias("met"), (F.sum("rows") / F.first("n")).alias("weight"))
    rows = rare.where(_reaches(F.size("met"), F.col("n"), least)).select("node", "n", F.col("met.column").alias("columns"), "weight")
    rows = stage(rows, "jaccard-rows")

    need = F.ceil(F.lit(least[0]) * F.col("n") / least[1])
    first = stage(rows.select("node", F.explode(F.slice("columns", F.lit(1), (F.size("columns") - need + 1).cast("int"))).alias("column")), "jaccard-first")
    hubs = stage(first.groupBy("column").agg(F.min("node").alias("hub"), F.count("*").alias("rows")).where("rows > 1").select("column", "hub"), "jaccard-hubs")
    classes = connected_components(first.join(hubs, "column").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    rows = stage(rows.join(classes, "node"), "jaccard-classes")
    return _multiplied(rows, least)


def _multiplied(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (u, v) among ``rows`` (node, n, columns, weight, component), whose pairs all lie within a component."""
    num, den = least
    sizes = rows.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.size("columns")).alias("entries"), F.max_by("node", F.struct("weight", "node")).alias("node"))
    large = stage(sizes.where((F.col("rows") > BLOCK) | (F.col("entries") > ENTRIES)).select("component", "node"), "jaccard-large")
    pivots = rows.join(large.select("node"), "node", "left_semi").select("component", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("columns").alias("others"))
    pivots = stage(pivots, "jaccard-pivots")
    placed = rows.join(pivots, "component", "left").withColumn("both", F.size(F.array_intersect("columns", "others")).cast("long"))
    either = F.col("n") + F.col("m") - F.col("both")
    ring = F.coalesce(F.floor(F.lit(den) * (either - F.col("both")) / ((den - num) * either)), F.lit(1)).cast("int")
    linked = F.coalesce((F.lit(den) * F.col("both") >= F.lit(num) * either) & (F.col("node") != F.col("pivot")), F.lit(False))
    placed = stage(placed.select("component", "node", "n", "columns", ring.alias("ring"), F.when(linked, F.col("pivot")).alias("pivot")), "jaccard-placed")

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("columns")) / ENTRIES)).cast("int").alias("blocks")
    rings = stage(placed.groupBy("component", "ring").agg(blocks), "jaccard-rings")
    of_row = placed.join(rings, ["component", "ring"]).select("component", "ring", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", "n", "columns")
    of_row = stage(of_row, "jaccard-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ahead = rings.select("component", F.explode(F.array("ring", F.col("ring") - 1)).alias("ring_a"), F.col("ring").alias("ring_b"), F.col("blocks").alias("blocks_b"))
    tiles = rings.select("component", F.col("ring").alias("ring_a"), F.col("blocks").alias("blocks_a")).join(ahead, ["component", "ring_a"]).where("ring_b > 0")
    tiles = tiles.withColumn("block_a", every("blocks_a")).withColumn("block_b", every("blocks_b")).where("ring_a < ring_b OR block_a <= block_b")
    keys = ["component", "ring_a", "block_a", "ring_b", "block_b"]
    tiles = stage(tiles.select(*keys), "jaccard-tiles")

    def side(c: str, chosen: DataFrame) -> DataFrame:
        return chosen.join(of_row.withColumnsRenamed({"ring": f"ring_{c}", "block": f"block_{c}"}), ["component", f"ring_{c}", f"block_{c}"]).select(*(F.col(k).alias(k) for k in [*keys, "node", "n", "columns"]))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (_unpacked(t) for t in (left, right))
        u, v = tile_links(a, b if right.num_rows else None, least)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    # a tile of a block with itself gets its rows once
    found = side("a", tiles).groupBy(*keys).cogroup(side("b", tiles.where("ring_a < ring_b OR block_a < block_b")).groupBy(*keys)).applyInArrow(solve, "u long, v long")
    return found.union(placed.where("pivot IS NOT NULL").select("node", "pivot"))


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and sizes of the rows; row number and column of each entry."""
    lists = t["columns"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return t["node"].to_numpy(), t["n"].to_numpy(), np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def tile_links(a: tuple, b: tuple | None, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the nodes of two blocks (of a block with itself, where ``b`` is None) as all their linked pairs do."""
    num, den = least
    same, b = b is None, a if b is None else b
    (nodes_a, n, own_a, columns_a), (nodes_b, m, own_b, columns_b) = a, b
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    column, place, count = np.unique(np.concatenate([columns_a, columns_b]), return_inverse=True, return_counts=True)
    rank = np.empty(len(column), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(column))  # rarest first
    at_a, at_b = rank[place[: len(columns_a)]], rank[place[len(columns_a) :]]
    bound = -(-num * (n[:, None] + m[None, :]) // (num + den))
    alive = np.triu(np.ones(bound.shape, bool), 1) if same else np.ones(bound.shape, bool)
    rest_a, rest_b = np.bincount(own_a, minlength=len(n)), np.bincount(own_b, minlength=len(m))
    alive &= np.minimum(rest_a[:, None], rest_b[None, :]) >= bound
    overlap = np.zeros(bound.shape, np.float32)
    for lo in range(0, len(column), COLUMNS):
        rows_a, rows_b = alive.any(axis=1), alive.any(axis=0)
        if not rows_a.any():
            return none
        some_a, some_b = (at_a >= lo) & (at_a < lo + COLUMNS), (at_b >= lo) & (at_b < lo + COLUMNS)
        rest_a -= np.bincount(own_a[some_a], minlength=len(n))
        rest_b -= np.bincount(own_b[some_b], minlength=len(m))
        width = min(COLUMNS, len(column) - lo)
        left, right = (_dense(own[some], at[some] - lo, rows, width) for own, at, some, rows in ((own_a, at_a, some_a, rows_a), (own_b, at_b, some_b, rows_b)))
        inside = np.ix_(rows_a, rows_b)
        overlap[inside] += left @ right.T
        alive[inside] &= overlap[inside] + np.minimum(rest_a[rows_a][:, None], rest_b[rows_b][None, :]) >= bound[inside]
    low_a, low_b = nodes_a.copy(), nodes_b.copy()
    while True:  # the smallest node that each can be reached from
        new_a = np.minimum(low_a, np.where(alive, low_b[None, :], low_a[:, None]).min(axis=1, initial=np.iinfo(np.int64).max))
        new_b = np.minimum(low_b, np.where(alive, new_a[:, None], low_b[None, :]).min(axis=0, initial=np.iinfo(np.int64).max))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    u, v = np.concatenate([nodes_a, nodes_b]), np.concatenate([low_a, low_b])
    return u[u != v], v[u != v]


def _dense(own: np.ndarray, at: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The entries of the chosen ``rows`` as a matrix."""
    number = np.cumsum(rows) - 1
    kept = rows[own]
    out = np.zeros((rows.sum(), width), np.float32)
    out[number[own[kept]], at[kept]] = 1
    return out


def classes(texts: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """row, id, n and class (a row number, one per component; null for texts without words) of each of ``texts`` (row, id, text)."""
    spark = texts.sparkSession
    small_batches(spark)
    rows = stage(_sized(texts, shingle, least), "jaccard-sized")

    def by_set() -> DataFrame:
        sets = stage(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.min("n").alias("n")), "jaccard-sets")
        left = stage(_left(rows, sets, least), "jaccard-left")
        linked = connected_components(links(texts, left, shingle, least))
        return sets.join(linked, sets.row == linked.node, "left").select("digest", F.coalesce("component", "row").alias("class"))

    found = settle(spark, "jaccard-by-set", by_set)
    # both sides are scans with a shuffle each, so that AQE can split a set that many rows share
    return rows.where("n > 0").select("row", "id", "n", "digest").join(found, "digest").drop("digest").union(rows.where("n = 0").select("row", "id", "n", F.lit(None).cast("long")))


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    ``least`` is the similarity at which two documents link, as a fraction. ``docs`` has to give the same rows in the same
    order each time it is read, as a table does.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = stage(classes(texts, shingle, least), "jaccard-labels")
    lowest = stage(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("low")), "jaccard-lowest")
    linked = rows.where("class IS NOT NULL").join(lowest, "class").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    return linked.union(rows.where("class IS NULL").select("id", "n", "id"))
