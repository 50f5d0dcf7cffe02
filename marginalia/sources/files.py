"""Files as a DataFrame: listing, guarded loading, outcomes and the ingestion report.

Spark's own file source leaves out empty files and names with a leading ``_`` or ``.``, all of which
the report has to count. So names are listed by a data source of our own (``listing``) and tasks read the bytes, both
through Arrow's file systems: local paths and the stores that it knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.plans.staging import delete, new_path, settle, stage

from .listing import list_files

EXTENSIONS = (".md", ".txt", ".py", ".json", ".yaml", ".yml")
MAX_BYTES, SNIFF_BYTES, CONTROL_SHARE = 2_000_000, 4096, 0.02
BLOCK_BYTES = 1 << 22
OUTCOMES = ("skipped_hidden", "skipped_extension", "skipped_empty", "skipped_too_large", "failed", "loaded")


def read_bytes(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """``files`` with content (null if over ``most`` bytes) and error (null if it was read)."""
    from pyspark.sql import types as T

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def one(path: str, size: int | None) -> tuple[bytes | None, str | None]:
        if (size or 0) > most:
            return None, None
        try:
            system, path = afs.FileSystem.from_uri(path)
            with system.open_input_stream(path) as f:
                return f.read(), None
        except Exception as e:  # the report counts whatever fails
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, got, held = 0, [], 0

            def block() -> pa.RecordBatch:
                contents, errors = zip(*got, strict=True)
                return pa.RecordBatch.from_arrays([*batch.slice(begin, len(got)).columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=[f.name for f in schema.fields])  # noqa: B023

            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if got and held + (size or 0) > BLOCK_BYTES:  # so memory is bounded by a block or by one file
                    yield block()
                    begin, got, held = begin + len(got), [], 0
                got.append(one(path, size))
                held += len(got[-1][0] or b"")
            if got:
                yield block()

    # dealt to as many tasks as shuffles have: names are few bytes, so that Spark would leave all files to one task; by a hash of the
    # path, as it takes rows that a join or grouping has dealt by path for dealt already
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def write_texts(rows: DataFrame, into: str, folder: str = "folder", text: str = "text") -> None:
    """Each row's text and a line end as a file of its own, in the folder below ``into`` that the row names; a null text is empty.

    Spark's own writer makes a checksum file beside each file, moves all of them one by one on the driver, and joins rows of one folder. Here tasks
    write and move a file when it is whole; a task that is run again, over the same rows, replaces what it has written.
    """
    aside = new_path(rows.sparkSession, "unfinished")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        (system, top), (_, own) = afs.FileSystem.from_uri(into), afs.FileSystem.from_uri(aside)
        system.create_dir(own)
        for batch in batches:
            for where, what in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                system.create_dir(f"{top}/{where}")
                with system.open_output_stream(unfinished := f"{own}/{task.taskAttemptId()}-{n}") as f:
                    f.write((what or b"") + b"\n")
                system.move(unfinished, f"{top}/{where}/part-{task.partitionId():05d}-{n}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(folder, text).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    delete(rows.sparkSession, [aside])


def mark_written(into: str) -> None:
    """Spark's mark of a folder that is written, a file without content."""
    system, top = afs.FileSystem.from_uri(into)
    system.create_dir(top)
    system.open_output_stream(f"{top}/_SUCCESS").close()


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(tx._col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """The last suffix in lower case; a leading dot makes none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def is_hidden(path: Column | str) -> Column:
    return F.exists(F.split(tx._col(path), "/"), lambda p: F.startswith(p, F.lit(".")))


def looks_binary(content: Column | str) -> Column:
    """A NUL byte anywhere, or over 2 % control bytes in the first 4096."""
    b = tx._col(content)
    head = F.decode(F.substring(b, 1, SNIFF_BYTES), "ISO-8859-1")
    controls = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0e-\x1f]", ""))
    share = controls / F.least(F.lit(SNIFF_BYTES), F.length(b))
    return (F.length(b) > 0) & ((F.instr(F.decode(b, "ISO-8859-1"), "\x00") > 0) | (share > CONTROL_SHARE))


def decoded(content: Column | str) -> Column:
    """UTF-8 where it is valid, else latin-1. A byte order mark stays."""
    b = tx._col(content)
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def load_text(read: DataFrame) -> DataFrame:
    """``read`` (see read_bytes) with raw: its text, null if too large, binary or unreadable."""
    ok = F.col("content").isNotNull() & ~looks_binary("content")
    return read.withColumn("raw", F.when(ok, decoded("content")))


def outcome(text: Column | str = "text", extensions: Iterable[str] = EXTENSIONS, path: str = "path", failed: Column | None = None) -> Column:
    """What becomes of a file, the first that holds of: hidden, wrong extension, failed, not loadable, blank.

    A markdown note that cannot be loaded counts as empty, any other file as too large.
    """
    allowed = [e.lower() for e in extensions]
    ext = extension(path)
    t = tx._col(text)
    return (
        F.when(is_hidden(path), "skipped_hidden")
        .when(~ext.isin(allowed) if allowed else F.lit(False), "skipped_extension")
        .when(F.lit(False) if failed is None else failed, "failed")
        .when(t.isNull(), F.when(ext == ".md", "skipped_empty").otherwise("skipped_too_large"))
        .when(tx.is_blank(t), "skipped_empty")
        .otherwise("loaded")
    )


def report(outcomes: DataFrame, path: str = "path") -> DataFrame:
    """One row: scanned, a counter per outcome, and the loaded files by extension."""
    by_ext = outcomes.where("outcome = 'loaded'").groupBy(extension(path).alias("ext")).agg(F.count("*").alias("n"))
    listed = by_ext.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("by_extension"))
    counts = outcomes.agg(F.count("*").alias("scanned"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    return counts.join(listed, F.lit(True), "left")


def load_documents(spark: SparkSession, inputs: Iterable[str], extensions: Iterable[str] = EXTENSIONS, recursive: bool = True, collection: str | None = None, vault_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and the report. Notes (.md) have front matter, embeds and links resolved; see sources.notes.

    A document: doc_id, text, source, uri, title, ext, mtime, size_bytes, content_hash, collection, and a note's
    frontmatter (JSON), frontmatter_tags, inline_tags, classification.
    """
    from .notes import NOTE_COLUMNS, load_notes

    extensions = tuple(extensions)

    def build() -> DataFrame:
        files = list_files(spark, inputs, recursive)
        read = stage(load_text(read_bytes(files)).drop("content"), "files")  # each file is read once
        plain = read.where(extension("path") != ".md").select("path", "size", "mtime", "error", F.col("raw").alias("text"))
        markdown = read.where(extension("path") == ".md")
        if markdown.isEmpty():  # neither the vault nor its joins are needed
            both = plain.withColumns({name: F.lit(None).cast(kind) for name, kind in NOTE_COLUMNS.items()})
        else:
            vault = stage(load_text(read_bytes(list_files(spark, [vault_root]))).drop("content"), "vault") if vault_root else read
            both = load_notes(markdown, vault, vault_root).unionByName(plain, allowMissingColumns=True)
        return both.withColumn("outcome", outcome("text", extensions, failed=F.col("error").isNotNull()))

    judged = settle(spark, "judged", build)
    hashed = judged.where("outcome = 'loaded'").withColumn("content_hash", tx.content_hash("text"))
    docs = hashed.select(
        tx.doc_id("path", "content_hash").alias("doc_id"), "text", F.lit("filesystem").alias("source"), F.col("path").alias("uri"), stem("path").alias("title"), extension("path").alias("ext"),
        "mtime", F.col("size").alias("size_bytes"), "content_hash", F.lit(collection).cast("string").alias("collection"), "frontmatter", "frontmatter_tags", "inline_tags", "classification",
    )
    return docs, report(judged)


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by uri."""
    return docs.orderBy("uri").limit(n)
