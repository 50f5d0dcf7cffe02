import threading

import pytest
from pyspark.sql import functions as F

from marginalia.sources import store, versions
from marginalia.sources.versions import ConcurrentWrite, VersionedTable


def rows(spark, *some):
    return spark.createDataFrame(list(some), "uri string, text string")


def texts(table, version=None):
    return sorted((r.uri, r.text) for r in table.read(version).collect())


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.latest() == 0
    with pytest.raises(ValueError, match="nothing"):
        t.read()
    assert t.replace(rows(spark, ("a", "1"), ("b", "1"))) == 1
    pinned = t.read()
    assert t.append(rows(spark, ("c", "2"), ("c", "2"))) == 2
    assert t.upsert(rows(spark, ("a", "3"), (None, "3")), rows(spark, ("c", ""))) == 3
    assert sorted(map(str, texts_of := [(r.uri, r.text) for r in t.read().collect()])) == sorted(map(str, [("a", "3"), ("b", "1"), (None, "3")])) and len(texts_of) == 3
    assert texts(t, 1) == [("a", "1"), ("b", "1")] == sorted((r.uri, r.text) for r in pinned.collect())
    assert t.replace(t.read().where("uri IS NOT NULL")) == 4  # read from itself
    assert texts(t) == [("a", "3"), ("b", "1")]

    monkeypatch.setattr(versions, "create_once", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # killed after its rows were written
        t.replace(rows(spark, ("z", "9")))
    monkeypatch.undo()
    assert t.latest() == 4 and texts(t) == [("a", "3"), ("b", "1")]


def test_two_writers(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.replace(rows(spark, ("a", "1")))
    a.append(rows(spark, ("b", "2")), base=1)
    with pytest.raises(ConcurrentWrite):
        b.append(rows(spark, ("c", "2")), base=1)
    assert texts(b) == [("a", "1"), ("b", "2")]
    done, refused = [], []

    def race(n):
        try:
            done.append(b.append(rows(spark, (f"r{n}", "")), base=2))
        except ConcurrentWrite:
            refused.append(n)

    racers = [threading.Thread(target=race, args=(n,)) for n in range(4)]
    [r.start() for r in racers]
    [r.join() for r in racers]
    assert done == [3] and len(refused) == 3 and b.read().count() == 3


def test_batches_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert [t.append(rows(spark, ("a", "1")), ("s", n)) for n in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert t.append(rows(spark, ("a", "1")), ("other", 0)) == 3 and t.read().count() == 3


def test_compact_and_vacuum(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for n in range(4):
        t.upsert(rows(spark, ("a", str(n)), (f"x{n}", "")))
    before = texts(t)
    t.compact()
    state = t.state()
    assert texts(t) == before and len(state["folders"]) == 1 and not state["tombstones"] and ("a", "3") in before and len(before) == 5
    t.upsert(rows(spark, ("a", "4")))
    t.vacuum(keep=2)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3 and len(list((tmp_path / "t" / "log").glob("*.json"))) == 2
    assert ("a", "4") in texts(t) and texts(t, t.latest() - 1) == before
    with pytest.raises(Exception):
        t.read(1)


def test_columns(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, ("a", "1")))
    t.append(rows(spark, ("b", "2")).withColumn("more", F.lit(5)))
    assert sorted((r.uri, r.more) for r in t.read().collect()) == [("a", None), ("b", 5)]
    with pytest.raises(TypeError, match="more"):
        t.append(rows(spark, ("b", "2")).withColumn("more", F.lit("x")))
    t.replace(rows(spark).limit(0))
    assert t.read().count() == 0 and t.read().columns == ["uri", "text"]


def test_rename_elsewhere(spark, tmp_path, monkeypatch):
    """The way of file systems that are not the local one."""
    monkeypatch.setattr(versions, "_local", lambda path: None)
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.replace(rows(spark, ("a", "1")))
    with pytest.raises(ConcurrentWrite):
        t.append(rows(spark, ("b", "1")), base=0)
    assert texts(t) == [("a", "1")]


def test_index_reads_itself(spark, tmp_path):
    index = store.IndexTable(spark, str(tmp_path / "i"), "uri")
    index.save(rows(spark, ("a", "1"), ("b", "2")))
    index.save(index.rows().where("uri = 'a'"))
    index.upsert(rows(spark, ("a", "9")))
    assert [(r.uri, r.text) for r in index.rows().collect()] == [("a", "9")] and index.rows(1).count() == 2
