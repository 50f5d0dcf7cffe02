"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text
ever seen. A batch is grouped by digest (counts and the best row combine before the
shuffle) and met with the index once, by a sort-merge join that keeps all of the batch's digests: those without a
match are the anti-join, they are new and appended; the others are known. The index
keeps its layout, so only the batch's digests are shuffled. Everything is DataFrame
operations; texts never leave the scan, only ids, lengths and digests do.

An append adds a file to each bucket. Once there are more than ``most_files`` of them the index is compacted: written anew, with one sorted file per
bucket, as the next generation, which counts from the moment its mark is created. The generation before stays for those who still
read it. The scan of a compacted index is already in order, so it is not sorted again.

One writer at a time: a batch holds the index by a file that only one can create, another one is refused (``ConcurrentWrite``). A driver that was
killed leaves the file behind; the same batch given again takes it over, and ``release`` removes it for good.

A batch has an id that its rows in the index carry. A batch that is given again under its id, as a job
does that failed after the append, gets the same answer: rows of the same batch are its own.

Defined results: null text counts as empty, and empty texts are equal to one another.
Of equal texts the row with the most code points stays, then the smallest id (null ids
last), then the first of repeated rows. Texts that an earlier batch brought are all
dropped in favour of the indexed id. An empty batch appends nothing. Ids may be of any type that
text can hold and give back. Columns beside the id and text are ignored by ``label`` and kept by
``keep``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.staging import delete, exists, names, new_path, stage
from marginalia.sources.versions import ConcurrentWrite, create_once

from .common import SPACE, fresh, text_or_empty

INDEX_SCHEMA = "digest string, batch string, keep_id string, group_size long"
#: Buckets of an index whose size is not known ahead, the texts that one bucket should hold (about 150 MB), and Spark's own limit.
BUCKETS, BUCKET_TEXTS, MOST_BUCKETS = 64, 1_000_000, 100_000
#: Files of a bucket before it is compacted.
MOST_FILES = 8
ORDERED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def buckets_for(texts: int) -> int:
    """The buckets of an index that is to hold so many distinct texts."""
    return min(MOST_BUCKETS, max(BUCKETS, -(-texts // BUCKET_TEXTS)))


def squeezed(text: F.Column) -> F.Column:
    """``text`` without white space. Six plain replacements run far faster than a pattern."""
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


class DigestIndex:
    """The digests of all texts kept so far, at ``path`` in ``buckets`` buckets; ``buckets_for`` says how many are wanted.

    A new path makes an empty index; an existing one is opened again, with the bucket count
    it was made with (another one is refused). The folder is known to the session's catalog by a
    name of its own until ``close``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_files: int = MOST_FILES):
        self.spark, self.path, self.most_files = spark, (path or new_path(spark, "digest-index")).rstrip("/"), most_files
        self.buckets = self._buckets(buckets)
        self.name, self.generation = f"digest_index_{uuid.uuid4().hex}", -1
        self.refresh()

    def _buckets(self, wanted: int | None) -> int:
        """The bucket count, kept beside the index."""
        about = f"{self.path}.about"
        if exists(self.spark, about):
            made = self.spark.read.schema("buckets int").json(about).first()["buckets"]
            if wanted not in (None, made):
                raise ValueError(f"the index at {self.path} has {made} buckets, not {wanted}")
            return made
        self.spark.createDataFrame([(wanted or BUCKETS,)], "buckets int").coalesce(1).write.json(about)
        return wanted or BUCKETS

    def _folder(self, generation: int) -> str:
        return f"{self.path}/{generation:06d}"

    def _table(self, name: str, folder: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def refresh(self) -> None:
        """See what others have written since."""
        marks = f"{self.path}.generations"
        latest = max((int(n) for n in names(self.spark, marks) if n.isdigit()), default=0)
        if latest != self.generation:
            self.close()
            self._table(self.name, self._folder(latest))
            self.generation = latest
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Take the name out of the catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        """The index with its buckets, for joins on digest."""
        return self.spark.table(self.name)

    @contextmanager
    def _held(self, batch: str) -> Iterator[None]:
        """The index for this batch alone."""
        holder = f"{self.path}.writer"
        if not create_once(self.spark, holder, batch):
            by = "".join(r.value for r in self.spark.read.text(holder).collect())
            if by != batch:
                raise ConcurrentWrite(f"the index at {self.path} is held by batch {by}")
        try:
            self.refresh()
            yield
        finally:
            self.release()

    def release(self) -> None:
        """Let go of the index. Call it for a writer that was killed and will not come back."""
        delete(self.spark, [f"{self.path}.writer"])

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        (
            rows.select("digest", "batch", "keep_id", "group_size")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", folder).saveAsTable(name)
        )
        self.spark.catalog.refreshTable(name)

    def append(self, rows: DataFrame) -> None:
        """Add ``rows`` of new digests; one task writes a bucket's file."""
        self._write(rows.repartition(self.buckets, "digest"), self.name, self._folder(self.generation))

    def compact(self, batch: str | None = None) -> None:
        """Write the index anew with one file per bucket, as the next generation."""
        with self._held(batch or uuid.uuid4().hex):
            self._compact()

    def _compact(self) -> None:
        folder, name = self._folder(self.generation + 1), f"{self.name}_next"
        delete(self.spark, [folder])  # of a compaction that was not finished
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._table(name, folder)
        # grouped by the buckets' key, so buckets stay where they are
        once = self.rows().groupBy("digest").agg(F.min(F.struct("batch", "keep_id", "group_size")).alias("x")).select("digest", "x.*")
        self._write(once, name, folder)
        self.spark.sql(f"DROP TABLE {name}")
        create_once(self.spark, f"{self.path}.generations/{self.generation + 1}", "")
        if self.generation > 0:
            delete(self.spark, [self._folder(self.generation - 1)])
        self.refresh()

    def label(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch and add it to the index.

        One row per row of ``docs``: row long (its place in the batch), doc_id, keep_id,
        group_size (rows of the batch with this text), kept, text_sha256.
        """
        return self._decided(stage(self._digests(docs, doc_id, text), "dedup-rows"), batch)

    def keep(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """The rows of ``docs`` that stay, with their columns, after adding it to the index.

        ``docs`` has to give the same rows in the same order each time it is read, as a
        table does.
        """
        (row,) = fresh(docs, "row")
        numbered = docs.withColumn(row, F.monotonically_increasing_id())
        labels = self._decided(stage(self._digests(numbered, doc_id, text, F.col(row)), "dedup-rows"), batch)
        gone = stage(labels.where(~F.col("kept")).select(F.col("row").alias(row)), "dedup-gone")
        return numbered.join(gone, row, "left_anti").drop(row)

    @staticmethod
    def _digests(docs: DataFrame, doc_id: str, text: str, row: F.Column | None = None) -> DataFrame:
        whole = text_or_empty(text)
        return docs.select(
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.length(whole).alias("code_points"),
            F.sha2(squeezed(whole), 256).alias("digest"),
        )

    def _met(self, groups: DataFrame) -> DataFrame:
        """All ``groups`` with the index row of their digest, nulls where it is new."""
        known = self.rows().select("digest", F.col("batch").alias("in_batch"), F.col("keep_id").alias("known_id")).hint("merge")
        return groups.join(known, "digest", "left")

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Jobs that begin in here take a compacted bucket's one file to be in order, as it was written."""
        before = self.spark.conf.get(ORDERED_SCAN)
        self.spark.conf.set(ORDERED_SCAN, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED_SCAN, before)

    def _decided(self, rows: DataFrame, batch: str | None) -> DataFrame:
        batch = batch or uuid.uuid4().hex
        best = F.min(F.struct(-F.col("code_points"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
        groups = stage(
            rows.groupBy("digest").agg(best, F.count("*").alias("group_size")).select(
                "digest", F.lit(batch).alias("batch"), F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("best_id"), F.col("best.doc_id").cast("string").alias("keep_id"), "group_size"
            ),
            "dedup-groups",
        )
        with self._held(batch):
            with self._in_order():
                met = stage(self._met(groups), "dedup-met")
            self.append(met.where("in_batch IS NULL"))
            if len(self.rows().inputFiles()) > self.most_files * self.buckets:
                self._compact()
        ours = F.coalesce(F.col("in_batch") == batch, F.lit(True))
        decided = met.select(
            "digest", "group_size", F.when(ours, F.col("keep_row")).alias("keep_row"), F.when(ours, F.col("best_id")).otherwise(F.col("known_id").cast(rows.schema["doc_id"].dataType)).alias("keep_id")
        )
        # both sides are scans with a shuffle each, so that AQE can split a digest that many rows share
        return rows.join(decided, "digest").select(
            "row", "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
        )
