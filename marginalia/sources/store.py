"""Index tables, their interchange as JSON lines, embedding caches, manifests and dumps."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.plans.staging import exists

from .versions import VersionedTable

CHUNK = "chunk_id string, doc_id string, text string, chunk_index int, start_char int, end_char int, section_heading string, section_path string, language string, metadata map<string,string>"
JSONL = f"chunk struct<{CHUNK.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map').replace(', ', ',')}>, vector array<double>"
EVAL = "qid string, query string, relevant_chunk_ids array<string>"
LEGACY_EVAL = "query string, expected_files array<string>"
CACHE = "key string, model string, vector array<double>"
PREVIEW, RAW_PREVIEW, SNIPPET = 600, 300, 200
DUMPED = ("source_path", "file_name", "root_dir", "relative_dir", "is_ai", "is_moc", "section_heading", "frontmatter_tags", "inline_tags")


class IndexTable:
    """Chunks with vectors at ``path``, written whole or not at all and read version by version; see ``versions``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.table = spark, path, VersionedTable(spark, path, key)

    def rows(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def save(self, rows: DataFrame) -> None:
        """``rows`` become the index; they may be read from it."""
        self.table.replace(rows)

    def append(self, rows: DataFrame) -> None:
        """Add rows; nothing is replaced."""
        self.table.append(rows)

    def upsert(self, rows: DataFrame, to: str | None = None) -> IndexTable:
        """``rows`` replace those of the same key, here or in a new index at ``to``."""
        if to is None:
            self.table.upsert(rows)
            return self
        new, key = IndexTable(self.spark, to, self.table.key), self.table.key
        new.save(self.rows().join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True))
        return new

    def count(self) -> int:
        return self.rows().count()


def _parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (value and others) without blank ones, with ``r``, the line as a record, and ``bad``, whether it is none."""
    rows = lines.where(~tx.is_blank("value")).withColumn("r", F.from_json("value", f"{JSONL}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return rows.withColumn("bad", F.col("r._bad").isNotNull() | F.col("r.chunk").isNull())


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line and snippet of the lines of an exported index that are no record. Lines count from 0 in their file, blank ones too.

    A large file is read in splits, whose tasks do not know how many lines lie before them. So lines are counted by split, and the sums of the
    splits before are added to a line's place in its own.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    found = _parsed(lines).where("bad").select("file", "split", "at", F.substring("value", 1, SNIPPET).alias("snippet"))
    return found.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "snippet")


def read_index_jsonl(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """An exported index, chunk fields as columns. Without a file it is empty, blank lines are left out.

    Lines that are no record fail the call, with the file, the line (from 0) and its first 200 characters; that is one more pass over the
    text. Without ``check`` they fail the read when it comes to them, without a line number.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{CHUNK}, vector array<double>")
    rows = _parsed(spark.read.text(path).select("value", F.input_file_name().alias("file")))
    if check and not rows.where("bad").isEmpty():
        one = bad_lines(spark, path).orderBy("file", "line").first()
        raise ValueError(f"not a line of an index: {one.file}, line {one.line}: {one.snippet}")
    told = F.raise_error(F.concat(F.lit("not a line of an index: "), "file", F.lit(": "), F.substring("value", 1, SNIPPET)))
    good = rows.select(F.when(F.col("bad"), told.cast("string")).alias("_told"), "r.chunk.*", "r.vector")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return good.where("_told IS NULL").drop("_told").withColumn("metadata", F.coalesce("metadata", none))


def write_index_jsonl(rows: DataFrame, path: str) -> None:
    fields = [f.split(" ", 1) for f in CHUNK.split(", ")]
    chunk = F.struct(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))
    rows.select(chunk.alias("chunk"), "vector").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(EVAL).json(path, mode="FAILFAST").where("qid IS NOT NULL OR query IS NOT NULL")
    return rows.withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))


def read_legacy_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEGACY_EVAL).json(path, mode="FAILFAST").where("query IS NOT NULL")


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The embedding cache at ``path``, empty where there is none yet."""
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def sanitized(rows: DataFrame, sets: tuple[str, ...] = ()) -> DataFrame:
    """Each row as JSON text: times in ISO form, null fields kept; columns in ``sets`` sorted as text."""
    sorted_ = {c: F.array_sort(F.transform(c, lambda x: x.cast("string"))) for c in sets}
    return rows.withColumns(sorted_).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def retrieval_rows(rows: DataFrame, raw: bool = False) -> DataFrame:
    """The columns that a retrieval dump has; what ``rows`` lack is null."""
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    if raw:
        return rows.select(col("score"), col("source_path"), col("file_name"), col("section_heading"), tx.quote("text", RAW_PREVIEW).alias("text_preview"))
    return rows.select(col("score"), col("node_id"), *map(col, DUMPED), tx.quote("text", PREVIEW).alias("text_preview"), col("chunk_idx"), col("chunk_total"))


def dump_retrieval(query: str, rows: DataFrame, folder: str) -> str:
    """Write the retrieved rows of one query as JSON lines; return the folder written."""
    path = f"{folder}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    retrieval_rows(rows).withColumn("query", F.lit(query)).write.json(path)
    return path


def dump_response(query: str, response: str, cited: DataFrame, folder: str) -> str:
    path = f"{folder}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    listed = cited.agg(F.collect_list(F.struct("*")).alias("citations"))  # a pack's citations, few by its budget
    listed.select(F.lit(query).alias("query"), F.lit(response).alias("response"), "citations", F.current_timestamp().alias("timestamp")).write.json(path)
    return path


def write_eval(summary: DataFrame, details: DataFrame, path: str) -> None:
    """One JSON object ``{summary, per_query}``, as an eval set's results are read; its size is that of the eval set."""
    every = details.agg(F.array_sort(F.collect_list(F.struct(*details.columns))).alias("per_query"))
    summary.select(F.struct("*").alias("summary")).join(every, F.lit(True)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_traces(traces: DataFrame, path: str) -> None:
    """Query log: a row per answered query."""
    traces.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def manifest(name: str, corpus: list[str], extensions: list[str], recursive: bool, counts: dict[str, int], chunking: dict, embedding: dict, report: dict) -> str:
    """What an index was made from, as JSON."""
    about = {
        "name": name, "created_at": datetime.now(timezone.utc).isoformat(), "corpus": corpus, "extensions": sorted(extensions), "recursive": recursive,
        "counts": counts, "chunking": chunking, "embedding": embedding, "ingest_report": report, "store": "parquet",
    }
    return json.dumps(about, ensure_ascii=False, default=str)
