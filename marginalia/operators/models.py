"""Calls of models: requests of bounded size, tried again, with failures as rows and results that are kept."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.sources.versions import VersionedTable

ITEMS, BYTES, TRIES, WAIT = 64, 1 << 20, 4, 0.5
ERROR_CHARS = 500


def requests(sizes: list[int], items: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most ``items`` rows and ``most`` bytes; a larger row is a request of its own."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == items or held + size > most):
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def ask(function: Callable[..., list], inputs: list[list], kind: pa.DataType, tries: int, wait: float) -> list[tuple[object, str | None]]:
    """(result, error) of each row of a request, in order.

    A failure, a wrong number of results or results of another type: the request is made again, ``tries`` times in all, after about
    ``wait`` seconds and twice as long each time. Then its halves are asked once each, and so on, so that one row that
    the model refuses does not take the others with it.
    """
    n = len(inputs[0])
    for turn in range(tries):
        if turn:
            time.sleep(wait * 2 ** (turn - 1) * random.uniform(0.5, 1.5))
        try:
            got = list(function(*inputs))
            if len(got) != n:
                raise ValueError(f"{len(got)} results for {n} rows")
            pa.array(got, kind)
            return [(value, None) for value in got]
        except Exception as e:  # noqa: BLE001 - whatever a client raises is that row's outcome
            told = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
    if n == 1:
        return [(None, told)]
    half = n // 2
    return [r for part in (slice(0, half), slice(half, n)) for r in ask(function, [i[part] for i in inputs], kind, 1, wait)]


def with_model(rows: DataFrame, function: Callable[..., list], returns: str, inputs: tuple[str, ...] = ("text",), out: str = "vector", error: str | None = None, items: int = ITEMS, max_bytes: int = BYTES, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``rows`` with ``out``, of type ``returns``: ``function`` takes a list per column of ``inputs`` and returns a list.

    A request holds at most ``items`` rows and ``max_bytes`` of text; see ``ask`` for what is tried again. A row that fails in the end
    has a null ``out`` and the reason in the column ``error``; without such a column it fails the job. Rows with a null in
    ``inputs`` are not asked about: ``out`` is null, without an error. Repeated rows are asked about as often as they occur, and a task that
    Spark runs again asks again; ``Kept`` does neither. Raises ValueError where ``rows`` have a column of a new name already.
    """
    new = [out] + ([error] if error else [])
    if clash := {c.lower() for c in new} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(returns))] + ([T.StructField(error, T.StringType())] if error else []))
    kind = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            asked = [i for i, row in enumerate(zip(*columns, strict=True)) if None not in row]
            results: list[tuple[object, str | None]] = [(None, None)] * batch.num_rows
            sizes = [sum(len(str(c[i]).encode()) for c in columns) for i in asked]
            for start, end in requests(sizes, items, max_bytes):
                place = asked[start:end]
                for i, result in zip(place, ask(function, [[c[i] for i in place] for c in columns], kind, tries, wait), strict=True):
                    if result[1] and not error:
                        raise RuntimeError(f"a model failed {tries} times: {result[1]}")
                    results[i] = result
            made = [pa.array([r[0] for r in results], kind)] + ([pa.array([r[1] for r in results], pa.string())] if error else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *new])

    return rows.mapInArrow(run, schema)


class Kept:
    """Results of a model by key, at ``path``: what it has answered once is not asked again.

    A versioned table of key, value and error. ``ask`` works in rounds of about ``every`` keys, each committed when it is done, so a
    job that dies loses one round at most.
    """

    def __init__(self, spark: SparkSession, path: str, returns: str):
        self.spark, self.returns, self.table = spark, returns, VersionedTable(spark, path, "key")

    def rows(self) -> DataFrame:
        if self.table.latest():
            return self.table.read()
        return self.spark.createDataFrame([], f"key string, value {self.returns}, error string")

    def ask(self, wanted: DataFrame, function: Callable[[list[str]], list], every: int = 1_000_000, **limits: float) -> DataFrame:
        """key, value and error of the keys of ``wanted`` (key string, text): those without a value so far are asked about.

        Of rows that share a key one is asked about, the one with the smallest text. A null text or a null key is not: no row. ``limits``
        are those of ``with_model``.
        """
        texts = wanted.where("key IS NOT NULL AND text IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
        missing = lambda: texts.join(self.rows().where("error IS NULL").select("key"), "key", "left_anti")
        left = missing().count()
        rounds = -(-left // every)
        for n in range(rounds):
            some = missing().where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == n)
            self.table.upsert(with_model(some, function, self.returns, out="value", error="error", **limits).drop("text"))
        return self.rows().join(wanted.select("key").distinct(), "key", "left_semi")
