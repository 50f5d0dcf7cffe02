"""Hard negatives by bit-sliced integer products.

The score of a row with an anchor is the inner product of their whole-number components. A row's
components are held as bit-planes, the sign first. Planes are worked off most significant first: once those
down to bit b are added up, the rest of a score lies between (2^b - 1) times the sum of the anchor's
negative components and the same times that of its positive ones. So each pair has an interval that every
plane narrows, and it is dropped as soon as its interval

* lies outside all windows of scores that the anchor asks for, or
* ends below the k-th best lower end among pairs that are sure to lie in a window, for each window it may lie in.

What is left after the last plane has exact scores. It is done twice. First each anchor's positives are sought: the best
of its own label, one window without ends. Each positive then opens a window, from ``low`` to ``high`` percent of its
score, for rows of other labels.

Anchors are met with all rows block by slice: anchors in blocks of up to ANCHORS, rows in slices of up to ROWS, each
such tile a task's work of bounded size; positives only with rows of the same label. Tiles give their best, at most
k for each anchor and window, and a rank over all tiles follows. A label or a vector that a third of all rows share is
cut into slices like any other.

Defined results: components are floor(scale * x); rows with a null label, a null vector, or null or non-finite components
take no part; shorter vectors count as ended by zeros. Higher scores come first, ties go to the smaller id, null ids last;
a null id is no anchor. A row is not its own positive, but repeats of it are, and repeated anchors are answered one by one. With fewer
candidates than asked for all are returned, without any there is no row. Scores that may not fit into 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.plans.staging import stage

from .topk import LAST, extent, matrix, scaled

ANCHORS, ROWS, DENSE, CHUNK = 512, 8192, 4, 64
NO_END = 1 << 62


class Planes:
    """Rows of whole numbers as bit-planes, the sign first."""

    def __init__(self, x: np.ndarray, bits: int, most: int):
        self.bits, width = bits, x.shape[1]
        # sums of an anchor's components stay exact in the narrowest of these
        self.kind = np.float32 if width * most < 1 << 24 else np.float64 if width * most < 1 << 53 else np.int64
        self.planes = [(x >> b & 1).astype(self.kind) for b in range(bits, -1, -1)]

    def best(self, anchors: np.ndarray, allowed: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], k: int, ids: np.ndarray) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
        """Number of the anchor, number of its window, and the k best rows in it with their scores."""
        for lo in range(0, len(anchors), CHUNK):
            q = anchors[lo : lo + CHUNK].astype(self.kind)
            ahead = [(q @ p.T).astype(np.int64) for p in self.planes[:DENSE]]
            for n in range(len(q)):
                rows, scores = self._one(q[n], [d[n] for d in ahead], np.flatnonzero(allowed[lo + n]), low[lo + n], high[lo + n], k)
                for w, (least, most) in enumerate(zip(low[lo + n], high[lo + n])):
                    some = np.flatnonzero((scores >= least) & (scores <= most))
                    some = some[np.lexsort((ids[rows[some]], -scores[some]))[:k]]
                    yield lo + n, w, rows[some], scores[some]

    def _one(self, q: np.ndarray, ahead: list[np.ndarray], rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that no plane drops, and their scores."""
        down, up = (int(part.sum()) for part in (np.minimum(q, 0), np.maximum(q, 0)))
        low, high = low[:, None], high[:, None]
        scores = np.zeros(len(rows), np.int64)
        for i, plane in enumerate(self.planes):
            if not len(rows):
                break
            b = self.bits - i
            met = ahead[i][rows] if i < len(ahead) else (plane[rows] @ q).astype(np.int64)
            scores += (met << b) * (-1 if i == 0 else 1)
            rest = (1 << b) - 1
            least, most = scores + rest * down, scores + rest * up
            fit = (most >= low) & (least <= high)
            if len(rows) > k:
                sure = np.where((least >= low) & (most <= high), least, -NO_END)
                fit &= most >= np.partition(sure, len(rows) - k, axis=1)[:, len(rows) - k, None]
            kept = fit.any(axis=0)
            rows, scores = rows[kept], scores[kept]
        return rows, scores


def _tiles(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``anchors`` and ``rows`` with block and slice: of equal ``keys``, each anchor meets each row in one tile."""
    tiles = lambda most: F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int")
    slices, blocks = rows.groupBy(*keys).agg(tiles(ROWS).alias("slices")), anchors.groupBy(*keys).agg(tiles(ANCHORS).alias("blocks"))
    part = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if keys:
        sizes = stage(slices.join(blocks, keys), "mining-sizes")
        asks, data = anchors.join(sizes, keys), rows.join(sizes, keys)
    else:
        sizes = {"slices": F.lit(slices.first()[0]), "blocks": F.lit(blocks.first()[0])}
        asks, data = anchors.withColumns(sizes), rows.withColumns(sizes)
    asks = asks.select(*(F.col(c).alias(c) for c in anchors.columns), part("blocks").alias("block"), every("slices").alias("slice"))
    return asks, data.select(*rows.columns, part("slices").alias("slice"), every("blocks").alias("block"))


def _met(asks: DataFrame, data: DataFrame, keys: list[str], same: bool, width: int, most: int, k: int) -> DataFrame:
    """(anchor, window, vec_id, score): of each tile the k best for each anchor and window, of the same label or of others."""
    bits = int(most).bit_length()

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "window", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            q, planes = matrix(left["v"], width), Planes(matrix(right["v"], width), bits, most)
            ids = np.array([LAST if i is None else i for i in right["vec_id"].to_pylist()], np.int64)
            equal = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]
            allowed = equal & (left["row"].to_numpy()[:, None] != right["row"].to_numpy()[None, :]) if same else ~equal
            low, high = ([np.array(x, np.int64) for x in left[c].to_pylist()] for c in ("low", "high"))
            anchor = left["row"].to_numpy()
            for n, window, rows, scores in planes.best(q, allowed, low, high, k, ids):
                out["anchor"] += [anchor[n]] * len(rows)
                out["window"] += [window] * len(rows)
                out["vec_id"] += [None if i == LAST else i for i in ids[rows].tolist()]
                out["score"] += scores.tolist()
        return pa.table({"anchor": pa.array(out["anchor"], pa.int64()), "window": pa.array(out["window"], pa.int32()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    tile = [*keys, "block", "slice"]
    found = asks.groupBy(*tile).cogroup(data.groupBy(*tile)).applyInArrow(solve, "anchor long, window int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, k: int = 5, positives: int = 5, every: int = 100, scale: int = 256, low: int = 80, high: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. For each of an anchor's first ``positives`` rows of its label, the first ``k`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    vectors = stage(scaled(df.where(F.col(label).isNotNull()), vec_id, embedding, scale, F.col(label).alias("label")), "mining-vectors")
    width, _, most = extent(vectors)
    anchors = vectors.where(F.col("vec_id") % every == 0)
    no_end = lambda sign: F.array(F.lit(sign * NO_END)).alias
    asks, data = _tiles(vectors, anchors.select("row", "v", "label", no_end(-1)("low"), no_end(1)("high")), ["label"])
    good = stage(_met(asks, data, ["label"], True, width, most, positives).select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")

    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    score = F.col("positive_score")
    ends = F.struct("place", (-down(-score * low)).alias("low"), down(score * high).alias("high"))
    windows = good.groupBy("anchor").agg(F.array_sort(F.collect_list(ends)).alias("w")).select(F.col("anchor").alias("row"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asks, data = _tiles(vectors, stage(anchors.join(windows, "row").select("row", "v", "label", "low", "high"), "mining-windows"), [])
    bad = _met(asks, data, [], False, width, most, k).withColumn("place", F.col("window") + 1).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return bad.join(good, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
