"""Incremental ingestion: new files of a folder become chunks and vectors of an index, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import text as tx
from marginalia.operators import chunk, embed
from marginalia.sources import files


def new_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = files.EXTENSIONS) -> DataFrame:
    """Stream of (doc_id, text, uri) of files as they come; what ingestion skips is left out."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    seen = raw.where(F.col("length") <= files.MAX_BYTES).select(path.alias("path"), F.when(~files.looks_binary("content"), files.decoded("content")).alias("text"))
    good = seen.where(files.outcome("text", extensions) == "loaded")
    return good.select(tx.doc_id("path", tx.content_hash("text")).alias("doc_id"), "text", F.col("path").alias("uri"))


def ingest(docs: DataFrame, index: str, checkpoint: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> StreamingQuery:
    """Append chunks and vectors of ``docs`` to the Parquet table ``index``, as far as there are files now."""
    chunks = embed.dummy(chunk.fixed(docs, size, overlap, keep=("uri",)))
    return chunks.writeStream.format("parquet").option("path", index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
