"""Tables whose writes are whole or not at all.

A table is a folder: ``data`` holds Parquet folders that are written once and never changed, ``log`` one small file per
version that names the folders in force. A write puts its rows into a new folder and then creates the
file of the next version; whoever creates it first has written that version, a second writer is refused and its
folder is never read. A writer that dies before that leaves the table as it was. Readers take one version and
keep to it, so a table can be replaced by rows that are read from itself.

Rows are replaced by key without touching old folders: a version may name tombstones, keys with the version from which older
rows of that key no longer count. ``compact`` writes the rows in force into one folder and drops tombstones; ``vacuum``
deletes what only older versions name.

A write may carry a batch (source, number). Each version knows the last number of each source, so a batch that is given again
after a failure is passed over.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "_version"


class ConcurrentWrite(RuntimeError):
    """Another writer has committed the version that this write was to become."""


def _hadoop(spark: SparkSession, path: str) -> tuple:
    fs = spark._jvm.org.apache.hadoop.fs
    found = fs.Path(path)
    return fs, found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(path: str) -> str | None:
    """The place of a path on this machine's file system, if it is one."""
    return path.removeprefix("file://") if path.startswith("file:///") else path if "://" not in path and not path.startswith("file:") else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with all of ``text``; False if it is there already. It is never seen in part.

    On other file systems than the local one it is as exclusive as their rename without overwriting.
    """
    made = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    fs, temporary, system = _hadoop(spark, made)
    out = system.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if _local(path):
            os.link(_local(made), _local(path))
        else:
            _rename(spark, made, path)
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(temporary, False)


def _rename(spark: SparkSession, made: str, path: str) -> None:
    fs, temporary, _ = _hadoop(spark, made)
    context = fs.FileContext.getFileContext(temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(temporary, fs.Path(path), none)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise FileExistsError(path) from None
        raise


class VersionedTable:
    """A table at ``path`` whose rows are replaced by ``key``. A folder that is not there yet is a table of version 0 without rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "uri"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def latest(self) -> int:
        """The last version committed."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        _, log, system = _hadoop(self.spark, f"{self.path}/log")
        names = [s.getPath().getName() for s in system.listStatus(log)] if system.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def state(self, version: int | None = None) -> dict:
        """What a version is made of: folders, tombstones, schema (JSON or None), the last number of each source of batches."""
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "folders": [], "tombstones": [], "schema": None, "batches": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(self._file(version), wholetext=True).collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        return self._in_force(self.state(version)).drop(VERSION)

    def _in_force(self, state: dict) -> DataFrame:
        if state["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        schema = T.StructType.fromJson(state["schema"]).add(VERSION, "long")
        if not state["folders"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in state["folders"]))
        if not state["tombstones"]:
            return rows
        dead = self.spark.read.parquet(*(f"{self.path}/data/{f}" for f in state["tombstones"])).groupBy(self.key).agg(F.max(VERSION).alias("_dead"))
        return rows.join(dead, self.key, "left").where(F.col("_dead").isNull() | (F.col(VERSION) >= F.col("_dead"))).select(*schema.names)

    def _written(self, rows: DataFrame, version: int) -> str:
        folder = uuid.uuid4().hex
        rows.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, state: dict, **changes: object) -> int:
        entry = state | changes | {"version": state["version"] + 1}
        if not create_once(self.spark, self._file(entry["version"]), json.dumps(entry)):
            raise ConcurrentWrite(f"version {entry['version']} of {self.path} was written by another writer")
        return entry["version"]

    @staticmethod
    def _done(state: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and state["batches"].get(batch[0], -1) >= batch[1]

    @staticmethod
    def _batches(state: dict, batch: tuple[str, int] | None) -> dict:
        return state["batches"] | ({batch[0]: batch[1]} if batch else {})

    @staticmethod
    def _schema(state: dict, rows: DataFrame) -> dict:
        """The table's columns and those that ``rows`` bring; a column keeps its type."""
        old = T.StructType.fromJson(state["schema"]).fields if state["schema"] else []
        types = {f.name: f.dataType for f in old}
        for f in rows.schema.fields:
            if types.get(f.name, f.dataType).simpleString() != f.dataType.simpleString():
                raise TypeError(f"column {f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")
        new = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in types]
        return T.StructType([*old, *new]).jsonValue()

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """``rows`` become the whole table. ``base``: the version that this write follows, the latest by default."""
        state = self.state(base)
        if self._done(state, batch):
            return state["version"]
        folder = self._written(rows, state["version"] + 1)
        return self._commit(state, folders=[folder], tombstones=[], schema=self._schema({"schema": None}, rows), batches=self._batches(state, batch))

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """Add rows; nothing is replaced."""
        state = self.state(base)
        if self._done(state, batch):
            return state["version"]
        folder = self._written(rows, state["version"] + 1)
        return self._commit(state, folders=[*state["folders"], folder], schema=self._schema(state, rows), batches=self._batches(state, batch))

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """``rows`` replace all rows of their keys; rows of the keys in ``gone`` go."""
        state = self.state(base)
        if self._done(state, batch):
            return state["version"]
        version = state["version"] + 1
        folder = self._written(rows, version)
        keys = self.spark.read.parquet(f"{self.path}/data/{folder}").select(self.key)
        keys = (keys if gone is None else keys.union(gone.select(self.key))).distinct()
        dead = [self._written(keys, version)] if state["folders"] else []
        return self._commit(state, folders=[*state["folders"], folder], tombstones=[*state["tombstones"], *dead], schema=self._schema(state, rows), batches=self._batches(state, batch))

    def compact(self) -> int:
        """The rows in force, in one folder and without tombstones, as a new version."""
        state = self.state()
        return self._commit(state, folders=[self._written(self._in_force(state).drop(VERSION), state["version"] + 1)], tombstones=[])

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` versions, and the folders that only those named. Readers of older versions fail then."""
        versions = self._versions()
        old, new = versions[:-keep], versions[-keep:]
        named = lambda some: {f for v in some for f in (lambda s: [*s["folders"], *s["tombstones"]])(self.state(v))}
        passed = named(old) - named(new)
        for place in [*map(self._file, old), *(f"{self.path}/data/{f}" for f in passed)]:
            _, found, system = _hadoop(self.spark, place)
            system.delete(found, True)
