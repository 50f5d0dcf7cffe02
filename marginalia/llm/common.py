"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that the word-based operators know.
SPACE = "\x20\t\n\x0b\x0c\r"
#: Bytes of whole texts that a Python worker is handed at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(i: int | None, modulus: int) -> int:
    """crc32 of the id as decimal text, modulo; a null id counts as empty text."""
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus


def fold_column(doc_id: str, modulus: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, one per name, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"__{name}{i}" for i in count()) if n not in taken) for name in names]


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """``schema`` with these fields at the end; fields of the same name (in any case) give way."""
    gone = {k.lower() for k in fields}
    kept = [f for f in schema.fields if f.name.lower() not in gone]
    return T.StructType(kept + [T.StructField(k, v) for k, v in fields.items()])


def put_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with these columns at the end; see with_fields."""
    gone = {k.lower() for k in columns}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session hands Python workers about ``most`` bytes at a time, at least one row, which bounds the
    memory that whole texts take. It holds for lazy results too, so it is not undone; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        column = batch.column(text)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        start = size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
