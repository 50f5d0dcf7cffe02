"""SimHash near-duplicates, found by anchor-point covering.

Anchors are the codewords of a covering code over the first 46 bits of a fingerprint: two
[23,12] Golay codes side by side. That code is perfect with radius 3, so each half of a
fingerprint has exactly one codeword within 3 bits, and together they are its home anchor.
If y differs from x in i bits of one half and j of the other (i + j <= 2), the home of x is
within 3 + i and 3 + j bits of the halves of y. So a fingerprint is sent to every anchor
within that radius plus threshold (about 60 of 2^24), and compared there with those at
home. No link can be missed, and each is met once.

Only distinct fingerprints take part; copies share theirs. Links between different
fingerprints are joined to components by star rounds on the cluster.

Defined results: null text counts as empty; texts of fewer words than a shingle hash as one
sequence; no words give fingerprint 0, linked like any other. Repeated rows each get a row.
A null id takes no part in a component's smallest id. Other columns are ignored by
``fingerprints`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import settle, stage

from .common import fresh, small_batches, text_blocks
from .components import connected_components

SEED, SHINGLE, THRESHOLD = 42, 3, 2
HALF = 23
#: Fixed value: the generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
VOTE_ROWS = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """A hash of each word shingle in order, repeats included; of the whole sequence where it has fewer words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space \x20 \x09-\x0D only
    if not words:
        return []
    n = len(words) - shingle + 1
    if n <= 1:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    whole, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles, repeats included."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    packed = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(packed), VOTE_ROWS):
        part = packed[lo : lo + VOTE_ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(packed)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row; and ``row``, where the column that numbers the rows is named."""
    extra = [F.col(row).alias("row")] if row else []
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *extra)
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "text"] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            kept = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps)], names=[f.name for f in schema.fields])

    return chosen.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def nearest_codeword() -> np.ndarray:
    """Of each 23-bit value the number of the one Golay codeword within 3 bits."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    words |= rest
    near = np.zeros(1 << HALF, dtype=np.int16)
    for weight in range(4):
        for bits in combinations(range(HALF), weight):
            near[words ^ sum(1 << b for b in bits)] = np.arange(1 << 12)
    return near


@lru_cache(maxsize=1)
def flips() -> np.ndarray:
    """All changes of at most THRESHOLD bits, those of fewer bits first."""
    return np.array([sum(1 << b for b in bits) for w in range(THRESHOLD + 1) for bits in combinations(range(HALF), w)], dtype=np.int64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home anchor of each fingerprint, and all anchors that it has to be sent to."""
    near, change = nearest_codeword(), flips()
    once = 1 + HALF
    bits = fps.view(np.uint64)
    halves = [near[(bits >> np.uint64(HALF * k) & np.uint64((1 << HALF) - 1)).astype(np.int64)[:, None] ^ change].astype(np.int64) for k in (0, 1)]
    home = halves[0][:, 0] << 12 | halves[1][:, 0]
    sent = []
    for a, b in zip(*halves, strict=True):
        a1, b1 = np.unique(a[:once]), np.unique(b[:once])
        far = [a[0] << 12 | np.unique(b), np.unique(a) << 12 | b[0], (a1[:, None] << 12 | b1).ravel()]
        sent.append(np.unique(np.concatenate(far)))
    return home, sent


def links(distinct: DataFrame) -> DataFrame:
    """All pairs u < v of the distinct fingerprints ``fp`` that differ in at most THRESHOLD bits."""
    schema = "fp long, home int, sent array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(lo, 4096)
                home, sent = anchors(fps.to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sent)]), pa.int32()), pa.array(np.concatenate(sent), pa.int32()))
                yield pa.RecordBatch.from_arrays([fps, pa.array(home, pa.int32()), lists], names=["fp", "home", "sent"])

    placed = stage(distinct.select("fp").mapInArrow(run, schema), "simhash-anchors")
    at_home = placed.select(F.col("home").alias("anchor"), F.col("fp").alias("u"))
    guests = placed.select(F.explode("sent").alias("anchor"), F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD)
    return at_home.join(guests, (at_home.anchor == guests.anchor) & near).select("u", "v")


def components(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, ...), written once, with component (its smallest fingerprint) and component_id (the smallest id reachable)."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = stage(rows, "simhash-rows")

    def by_fp() -> DataFrame:
        distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
        linked = connected_components(links(distinct))
        joined = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
        joined = stage(joined, "simhash-components")
        lowest = stage(joined.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lowest")
        return joined.join(lowest, "component").select("fp", "component", "component_id")

    return rows.join(settle(spark, "simhash-classes", by_fp), "fp")


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    found = components(fingerprints(docs, doc_id, text))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def later_rows(numbered: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` of all rows but the first of each component: the smallest id, nulls last, then the smallest ``row``."""
    found = stage(components(fingerprints(numbered, doc_id, text, row)).select("doc_id", "row", "component"), "simhash-found")
    # by component and not by its id: ids may repeat or be null
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return stage(found.select("row").join(first, "row", "left_anti"), "simhash-later")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one each, with their columns.

    ``docs`` has to give the same rows in the same order each time it is read, as a table does.
    """
    (row,) = fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(later_rows(numbered, row, doc_id, text).withColumnRenamed("row", row), row, "left_anti").drop(row)
