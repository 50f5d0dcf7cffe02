"""Listing of files as a data source: ``spark.read.format("marginalia_files")``, and ``readStream`` alike.

Folders are opened in tasks. The source goes down from each input, level by level, until there are folders enough to spread; it gives the
files it met, and folders still to be opened as rows without a size. ``list_files`` deals these out by their path and lists all below. So
neither names of files nor of folders reach the driver, and the number of tasks doesn't follow that of folders. All names
count, also those with a leading dot or ``_``, which Spark's own source leaves out, and empty files.

As a stream it has no memory of its own: each micro-batch lists everything as it is then, and what compares it with what is known
(``streaming.sync``) finds new, changed and deleted files. Offsets are times of scans.
"""

from __future__ import annotations

import errno
import glob
import json
import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "marginalia_files"
FILES = "path string, size long, mtime timestamp"
ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
FOLDERS, LEVELS, ROWS = 64, 4, 1 << 13


@dataclass(frozen=True)
class Place:
    """A file, or a folder with its files, and all below where ``deep``. A local path is real; a remote one has a scheme."""

    path: str
    deep: bool
    remote: bool

    def system(self) -> tuple[afs.FileSystem, str, str]:
        """Its file system, its path there, and what stands in front of that in names."""
        if not self.remote:
            return afs.LocalFileSystem(), self.path, ""
        system, path = afs.FileSystem.from_uri(self.path)
        return system, path, self.path[: self.path.index(path)] if path in self.path else ""


@dataclass
class Share(InputPartition):
    """Inputs that one task begins with."""

    places: list[Place]


def inputs_of(items: Iterable[str], recursive: bool) -> Iterator[Place]:
    """Files and folders of the inputs; patterns are relative to here, absolute paths that do not exist are left out."""
    for item in items:
        item = os.path.expanduser(item)
        if "://" in item:
            yield Place(item, recursive, True)
        elif os.path.exists(item):
            yield Place(os.path.realpath(item), recursive, False)
        elif not os.path.isabs(item):
            yield from inputs_of((os.path.abspath(m) for m in glob.glob(item, recursive=True, include_hidden=True)), recursive)


def _entries(place: Place) -> Iterator[tuple[str, int | None, int | None]]:
    """Path, size and microseconds of the last change of what lies in a folder, folders without the latter two; a file is its own content."""
    system, path, head = place.system()
    if not isinstance(system, afs.LocalFileSystem):
        about = system.get_file_info(path)
        found = [about] if about.type == afs.FileType.File else system.get_file_info(afs.FileSelector(path)) if about.type == afs.FileType.Directory else []
        for f in found:
            if f.type == afs.FileType.Directory:
                yield head + f.path, None, None
            elif f.type == afs.FileType.File:
                yield head + f.path, f.size, None if f.mtime_ns is None else f.mtime_ns // 1000
    elif os.path.isfile(path):
        about = os.stat(path)
        yield head + path, about.st_size, about.st_mtime_ns // 1000
    elif os.path.isdir(path):
        with os.scandir(path) as found:  # a name at a time, as folders may be wide
            for f in found:
                name = os.path.realpath(f.path) if f.is_symlink() and not place.remote else head + f.path
                try:
                    folder, about = f.is_dir(), f.stat() if f.is_file() else None
                except OSError as e:
                    if e.errno not in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link in a circle
                        raise
                    continue
                if folder:
                    yield name, None, None
                elif about:
                    yield name, about.st_size, about.st_mtime_ns // 1000


def opened(places: Iterable[Place], most: int) -> Iterator[Place]:
    """The same files as at least ``most`` folders, if they have as many in their first levels. Few are held at a time."""
    done, now = 0, list(places)
    for _ in range(LEVELS):
        if done + len(now) >= most or not any(p.deep for p in now):
            break
        below: list[Place] = []
        for p in now:
            done += 1
            yield Place(p.path, False, p.remote)
            for path, size, _ in _entries(p) if p.deep else ():
                if size is None and len(below) < most:
                    below.append(Place(path, True, p.remote))
                elif size is None:
                    yield Place(path, True, p.remote)
        now = below
    yield from now


def spread(places: list[Place], most: int) -> list[Place]:
    """``opened`` at once."""
    return list(opened(places, most))


def listed(place: Place, seen: set[str]) -> Iterator[tuple[str, int, int]]:
    """Files of a place, a folder at a time; a folder that has been ``seen``, such as one met again by way of a link, is passed over."""
    waiting = [place]
    while waiting:
        now = waiting.pop()
        if now.path in seen:
            continue
        seen.add(now.path)
        for row in _entries(now):
            if row[1] is not None:
                yield row
            elif now.deep:
                waiting.append(Place(row[0], True, now.remote))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), ARROW, strict=True)], schema=ARROW)


def _first(places: list[Place]) -> Iterator[tuple[str, int | None, int | None]]:
    """Files of the first levels, and the folders below these, without a size."""
    seen: set[str] = set()
    for p in opened(places, FOLDERS):
        if p.deep:
            yield p.path, None, None
        else:
            yield from listed(p, seen)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files as they come, and those below folders."""

    def rows() -> Iterator[tuple]:
        seen: set[str] = set()
        for batch in batches:
            for path in batch.column("path").filter(pc.is_null(batch.column("size"))).to_pylist():
                yield from listed(Place(path, True, "://" in path), seen)
            known = batch.filter(pc.is_valid(batch.column("size")))
            yield from zip(known.column("path").to_pylist(), known.column("size").to_pylist(), known.column("mtime").cast(pa.int64()).to_pylist(), strict=True)

    yield from _batches(rows())


class Scan(DataSourceReader):
    """The beginning of one listing of ``places``."""

    def __init__(self, places: list[Place]):
        self.places = places

    def partitions(self) -> list[Share]:
        return [Share(self.places[n::FOLDERS]) for n in range(min(FOLDERS, max(1, len(self.places))))]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from _batches(_first(partition.places))


class Scans(DataSourceStreamReader):
    """The beginning of a listing per micro-batch."""

    def __init__(self, places: list[Place]):
        self.places, self.last = places, 0

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1000)
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return Scan(self.places).partitions()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from _batches(_first(partition.places))

    def commit(self, end: dict) -> None:
        """Nothing is held."""


class Files(DataSource):
    """Options: ``inputs`` (a JSON list of folders, files and patterns) and ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def _places(self) -> list[Place]:
        return list(inputs_of(json.loads(self.options["inputs"]), self.options.get("recursive", "true").lower() == "true"))

    def reader(self, schema: object) -> Scan:
        return Scan(self._places())

    def streamReader(self, schema: object) -> Scans:
        return Scans(self._places())


def _options(inputs: Iterable[str], recursive: bool) -> dict[str, str]:
    # patterns are relative to the caller's folder, so they are resolved here
    return {"inputs": json.dumps([p.path for p in inputs_of(inputs, recursive)]), "recursive": str(recursive).lower()}


def _whole(begun: DataFrame) -> DataFrame:
    """``begun`` with its folders listed by as many tasks as shuffles have; by path, so that a folder met twice is listed once."""
    # a number of its own, as a few folders' names are few bytes, but may hold many files
    return begun.repartition(int(begun.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_rest, FILES)


def list_files(spark: SparkSession, inputs: Iterable[str], recursive: bool = True) -> DataFrame:
    """path, size and mtime of every distinct file of ``inputs``: folders, files, or patterns relative to here."""
    spark.dataSource.register(Files)
    # inputs may overlap
    return _whole(spark.read.format(NAME).options(**_options(inputs, recursive)).load()).groupBy("path").agg({"size": "max", "mtime": "max"}).toDF("path", "size", "mtime")


def stream_files(spark: SparkSession, inputs: Iterable[str], recursive: bool = True) -> DataFrame:
    """Stream of listings; see the module."""
    spark.dataSource.register(Files)
    return _whole(spark.readStream.format(NAME).options(**_options(inputs, recursive)).load())
