"""Ranked lexical search on a bit-sliced impact index.

A term's impact in a document is a whole number, its weight times its saturated frequency. Documents lie in blocks of
about BLOCK; within a block a term is held as bit-planes: slice b is a bitmap of the documents whose impact has bit b.
An item's scores come from bitwise carry arithmetic: the slices of its terms are summed by carry-save additions (sum and
carry planes of all documents at once), then one carry runs through the slices. The best are found from the most significant
slice down: documents that have the bit are taken whole while they are fewer than k, otherwise the rest go. Bits
are ordered by id, so ties fall to the smaller id. Each block returns its k best per item, and a rank over all blocks follows.

Blocks and items in groups of up to ITEMS meet tile by tile, so a task holds a block's postings and a group's terms. Only
terms of the items are indexed, by a join on the term that Spark may broadcast or shuffle by size and split where one term
fills a large share; numbers of documents, terms and occurrences are those of all documents.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. N counts the documents with a
term, L their terms with repeats, n those of one document. The weight of a term that df documents hold is
floor(1000 * ln((2N + 2) / (2df + 1))), and with m = 75 + (25 * n * N) div L its impact where it occurs tf times is
weight * ((10^9 * tf) div (1000 * tf + 12 * m)). A score is the sum over an item's terms, repeats included.

Defined results: null text has no terms; documents without a term of an item do not appear, nor do scores of 0, and an item without
any is without rows. Ties go to the smaller id, null ids last. Repeated documents and items are ranked one by one. Other
columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.plans.staging import stage

K, BLOCK, ITEMS = 20, 8192, 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LAST = np.iinfo(np.int64).max


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, BETWEEN, -1), lambda t: t != "")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers per document as two: planes of the sum without carries, and of the carries one slice up."""
    half = a ^ b
    carry = np.zeros_like(a)
    carry[1:] = (a & b | c & half)[:-1]
    return half ^ c, carry


class Slices:
    """The impacts of a block's documents by term, as bitmaps on demand; ``places`` number the documents by id."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, rows: int):
        order = np.argsort(term, kind="stable")
        self.term, self.place, self.impact = term[order], place[order], impact[order].astype(np.uint64)
        self.known, start = np.unique(self.term, return_index=True)
        self.ends = dict(zip(self.known.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(self.term)])))
        self.words = -(-rows // 64)
        self.made: dict[int, np.ndarray] = {}

    def most(self, term: int) -> int:
        lo, hi = self.ends[term]
        return int(self.impact[lo:hi].max())

    def of(self, term: int) -> np.ndarray:
        """One bitmap per bit of the term's largest impact, least significant first."""
        if term not in self.made:
            lo, hi = self.ends[term]
            place, impact = self.place[lo:hi], self.impact[lo:hi]
            bits = self.most(term).bit_length()
            flags = np.zeros((bits, self.words * 64), np.uint8)
            flags[:, place] = impact >> np.arange(bits, dtype=np.uint64)[:, None] & np.uint64(1)
            self.made[term] = np.packbits(flags, axis=1, bitorder="little").view("<u8")
            if len(self.made) > 512:
                self.made.pop(next(iter(self.made)))
        return self.made[term]

    def scores(self, wanted: list[tuple[int, int]]) -> np.ndarray:
        """Slices of the scores for ``wanted`` (term, times)."""
        here = [(t, n) for t, n in wanted if t in self.ends]
        depth = max(1, sum(self.most(t) * n for t, n in here).bit_length())
        total, carry = np.zeros((2, depth, self.words), np.uint64)
        for term, times in here:
            planes = self.of(term)
            for shift in range(times.bit_length()):
                if times >> shift & 1:
                    more = np.zeros_like(total)
                    more[shift : shift + len(planes)] = planes
                    total, carry = _add(total, carry, more)
        on = np.zeros(self.words, np.uint64)
        for b in range(depth):  # one carry through all slices
            half = total[b] ^ carry[b]
            total[b], on = half ^ on, total[b] & carry[b] | half & on
        return total


def ones(bitmap: np.ndarray) -> np.ndarray:
    """The places that a bitmap holds."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k places with the highest scores above 0, ties to the smaller place, and their scores."""
    taken, open_ = np.zeros_like(slices[0]), np.bitwise_or.reduce(slices, axis=0)
    for plane in slices[::-1]:
        with_bit = taken | open_ & plane
        if (n := int(np.bitwise_count(with_bit).sum())) > k:
            open_ &= plane
        else:
            taken, open_ = with_bit, open_ & ~plane
            if n == k:
                break
    sure = ones(taken)
    places = np.concatenate([sure, ones(open_)[: k - len(sure)]])
    bits = slices[:, places // 64] >> (places % 64).astype(np.uint64) & np.uint64(1)
    return places, (bits << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best of ``docs`` for each of ``items``."""
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), terms(F.col(item_text)).alias("terms"))
    asked = stage(asked, "impact-items")
    wanted = asked.select("item", F.explode("terms").alias("word")).groupBy("item", "word").agg(F.count("*").alias("times"))
    words = stage(wanted.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "impact-words")
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    count, total = found.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(1)).cast("long")).first()

    hits = found.select("row", "doc_id", F.size("terms").cast("long").alias("n"), F.explode("terms").alias("word")).join(words, "word")
    postings = stage(hits.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf")), "impact-postings")
    weight = F.floor(1000 * F.log(F.lit(2 * count + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = stage(postings.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("weight")), "impact-weights")
    m = 75 + _div(25 * F.col("n") * count, F.lit(total))
    impact = F.col("weight") * _div(F.col("tf") * 1000000000, 1000 * F.col("tf") + 12 * m)
    blocks = max(1, -(-count // BLOCK))
    asked_terms = wanted.join(words, "word").groupBy("item").agg(F.collect_list(F.struct("term", F.col("times").cast("long").alias("times"))).alias("wanted"))
    groups = max(1, -(-asked.count() // ITEMS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = postings.join(weights, "term").select("row", "doc_id", "term", impact.alias("impact"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("part"))
    right = asked_terms.select("item", "wanted", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("part"), every(blocks).alias("block"))

    def solve(data: pa.Table, asks: pa.Table) -> pa.Table:
        out = {c: [] for c in ("item", "doc_id", "score")}
        if data.num_rows and asks.num_rows:
            ids = np.array([LAST if i is None else i for i in data["doc_id"].to_pylist()], np.int64)
            rows, first, own = np.unique(data["row"].to_numpy(), return_index=True, return_inverse=True)
            order = np.lexsort((rows, ids[first]))
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            named = ids[first][order]
            index = Slices(data["term"].to_numpy(), place[own], data["impact"].to_numpy(), len(rows))
            for item, some in zip(asks["item"].to_pylist(), asks["wanted"].to_pylist()):
                places, scores = best(index.scores([(w["term"], w["times"]) for w in some]), k)
                out["item"] += [item] * len(places)
                out["doc_id"] += [None if i == LAST else i for i in named[places].tolist()]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    won = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(solve, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    won = won.withColumn("rank", rank).where(F.col("rank") <= k)
    return won.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)
