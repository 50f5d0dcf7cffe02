"""Near copies: SimHash classes confirmed by the texts, then an exact Jaccard join of what is left.

Two texts are near when the sets of their five-word shingles have a similarity of at least LEAST; texts
of fewer words are one shingle, texts without words are near to none.

Fingerprints of five-word shingles that differ in at most two bits are linked by anchor-point covering
(``simhash``). Each row of such a class is compared with the class's first row, text against text: pairs are as
many as rows, however large the class. A row that is near goes; one that only has a similar fingerprint does not.
Among the rows left all near pairs are found by the blocked sparse product (``jaccard``), and of
each component one row stays.

Defined results: rows are ordered by id, nulls last, then by place; the first of a class or component stays. No two rows
kept are near, and each row dropped has a chain of near pairs to one that is kept. All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.staging import settle, stage

from . import jaccard, simhash
from .common import fresh, small_batches, text_blocks

SHINGLE, LEAST = 5, (4, 5)


def near(a: str | None, b: str | None) -> bool:
    """Whether two texts are near."""
    a, b = (jaccard.shingle_set(t, SHINGLE) for t in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame) -> DataFrame:
    """``row`` of the ``pairs`` (row, text_a, text_b) whose texts are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks([batch], "text_b"):
                rows, a, b = (block.column(c).to_pylist() for c in ("row", "text_a", "text_b"))
                good = [row for row, *both in zip(rows, a, b, strict=True) if near(*both)]
                yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["row"])

    return pairs.mapInArrow(run, "row long")


def _of_classes(texts: DataFrame) -> DataFrame:
    """``row`` of the ``texts`` (row, id, text) that are near the first row of their SimHash class."""
    found = simhash.components(simhash.fingerprints(texts, "id", "text", "row", SHINGLE))
    found = stage(found.select("row", F.col("doc_id").alias("id"), "component"), "near-found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"), F.count("*").alias("rows"))
    pairs = stage(found.join(stage(first.where("rows > 1"), "near-first"), "component").where("row <> first").select("row", "first"), "near-pairs")
    named = pairs.select("row").union(pairs.select("first").distinct())
    some = stage(texts.select("row", "text").join(named, "row", "left_semi"), "near-texts")
    a, b = some.select(F.col("row").alias("first"), F.col("text").alias("text_a")), some.select("row", F.col("text").alias("text_b"))
    return _confirmed(pairs.join(a, "first").join(b, "row").select("row", "text_a", "text_b"))


def dropped(texts: DataFrame) -> DataFrame:
    """``row`` of the ``texts`` (row, id, text) that go."""
    small_batches(texts.sparkSession)
    copies = stage(_of_classes(texts), "near-copies")
    left = stage(jaccard.classes(texts.join(copies, "row", "left_anti"), SHINGLE, LEAST).where("class IS NOT NULL").select("row", "id", "class"), "near-left")
    first = stage(left.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first")), "near-stay")
    return copies.union(left.join(first, "class").where("row <> first").select("row"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when no two are near.

    ``docs`` has to give the same rows in the same order each time it is read, as a table does.
    """
    (row,) = fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    texts = numbered.select(F.col(row).alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    gone = settle(docs.sparkSession, "near-gone", lambda: dropped(texts)).withColumnRenamed("row", row)
    return numbered.join(gone, row, "left_anti").drop(row)
