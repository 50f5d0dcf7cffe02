"""An index kept equal to a folder: new, edited and deleted files, each batch applied once.

A listing is compared with the index by path: files that it lacks, or whose time or size differs, are read; those whose content
differs by hash are cut and embedded anew and replace all chunks of their path; paths that are gone, or no longer hold text, lose
theirs. The result is committed as one version (``sources.versions``) together with the number of the batch, so
a run that dies in the middle changes nothing, and one that is started again does the batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import text as tx
from marginalia.operators import chunk, embed
from marginalia.plans.staging import settle, stage
from marginalia.sources import files
from marginalia.sources.listing import stream_files
from marginalia.sources.versions import VersionedTable


def documents(listing: DataFrame, extensions: Iterable[str] = files.EXTENSIONS) -> DataFrame:
    """doc_id, uri, text, content_hash, mtime and size_bytes of the files of ``listing`` that ingestion loads."""
    read = files.load_text(files.read_bytes(listing))
    good = read.where(files.outcome("raw", extensions, failed=F.col("error").isNotNull()) == "loaded").withColumn("content_hash", tx.content_hash("raw"))
    return good.select(tx.doc_id("path", "content_hash").alias("doc_id"), F.col("path").alias("uri"), F.col("raw").alias("text"), "content_hash", "mtime", F.col("size").alias("size_bytes"))


def apply_documents(
    table: VersionedTable, docs: DataFrame, gone: DataFrame, batch: tuple[str, int] | None = None, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP
) -> int:
    """Replace the chunks of ``docs`` (doc_id, uri, text, ...) by path, and drop those of the paths in ``gone`` (uri); the version written."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return table.upsert(embedder(chunk.fixed(docs, size, overlap, keep=keep)), gone, batch)


def reconcile(
    table: VersionedTable, listing: DataFrame, batch: tuple[str, int] | None = None, extensions: Iterable[str] = files.EXTENSIONS, embedder: Callable[[DataFrame], DataFrame] = embed.dummy, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP
) -> int:
    """Make ``table`` the index of the files in ``listing`` (path, size, mtime), all there are; the version that is so."""
    spark, state = table.spark, table.state()
    if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
        return state["version"]
    listing = stage(listing, "sync-listing")  # seen once, or files might change between two looks
    if state["schema"] is None:
        known = spark.createDataFrame([], "uri string, known_hash string, known_mtime timestamp, known_size long")
    else:
        rows = table.read(state["version"]).groupBy("uri").agg(F.max("content_hash").alias("known_hash"), F.max("mtime").alias("known_mtime"), F.max("size_bytes").alias("known_size"))
        known = stage(rows, "sync-known")
    met = listing.join(known, listing.path == known.uri, "left")
    doubtful = met.where(F.col("uri").isNull() | ~F.col("mtime").eqNullSafe(F.col("known_mtime")) | ~F.col("size").eqNullSafe(F.col("known_size")))
    read = settle(spark, "sync-read", lambda: documents(doubtful.select("path", "size", "mtime"), extensions))
    changed = read.join(known, "uri", "left").where("known_hash IS NULL OR known_hash <> content_hash").select(*read.columns)
    away = known.join(listing.select(F.col("path").alias("uri")), "uri", "left_anti").select("uri")
    # looked at because it had changed, and no document any more
    emptied = doubtful.where("uri IS NOT NULL").select("uri").join(read.select("uri"), "uri", "left_anti")
    return apply_documents(table, changed, away.union(emptied), batch, embedder, size, overlap)


def sync(table: VersionedTable, inputs: Iterable[str], checkpoint: str, recursive: bool = True, every: str | None = None, **how: object) -> StreamingQuery:
    """Keep ``table`` the index of the files of ``inputs``: once, as they are now, or again ``every`` so often (such as "10 minutes").

    ``how``: see reconcile. A checkpoint that is opened again goes on with its batches; a new one begins anew.
    """

    def one(listing: DataFrame, number: int) -> None:
        source = listing.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        reconcile(table, listing.groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime")), (source, number), **how)

    when = {"processingTime": every} if every else {"availableNow": True}
    return stream_files(table.spark, inputs, recursive).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**when).start()
