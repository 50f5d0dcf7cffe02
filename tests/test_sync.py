import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunk, embed
from marginalia.sources import listing
from marginalia.sources.versions import VersionedTable
from marginalia.streaming import sync


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


def touch(path, seconds):
    os.utime(path, (seconds, seconds))


def held(table):
    return sorted((os.path.basename(r.uri), r.chunk_index, r.text) for r in table.read().collect())


def fresh(spark, folder):
    docs = sync.documents(listing.list_files(spark, [str(folder)]))
    return sorted((os.path.basename(r.uri), r.chunk_index, r.text) for r in embed.dummy(chunk.fixed(docs, keep=("uri",))).collect())


def test_edit_delete_restart(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep" / "er").mkdir(parents=True)
    put(folder, a="first " * 300, b="second", c="third", d="fourth")
    put(folder / "deep" / "er", e="fifth")
    for n, p in enumerate(folder.rglob("*.txt")):
        touch(p, 1000 + n)
    table, mark = VersionedTable(spark, str(tmp_path / "index")), str(tmp_path / "mark")
    run = lambda: sync.sync(table, [str(folder)], mark).awaitTermination()
    run()
    assert held(table) == fresh(spark, folder) and len(held(table)) == 6
    put(folder, a="now short", f="sixth", c=" \n")  # edited, new, emptied
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_bytes(b"\x00binary")
    run()
    assert held(table) == fresh(spark, folder) == [("a.txt", 0, "now short"), ("e.txt", 0, "fifth"), ("f.txt", 0, "sixth")]
    version = table.latest()
    touch(folder / "f.txt", 5)  # the same content: nothing is embedded anew
    run()
    assert held(table) == fresh(spark, folder)
    assert table.read().where(F.col("text") == "sixth").count() == 1 and table.latest() == version + 1


def test_a_batch_that_dies(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, a="one", b="two")
    table, mark = VersionedTable(spark, str(tmp_path / "index")), str(tmp_path / "mark")
    sync.sync(table, [str(folder)], mark).awaitTermination()
    put(folder, a="changed", c="three")
    touch(folder / "a.txt", 7)
    real = VersionedTable._commit
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a, **b: 1 / 0)
    with pytest.raises(Exception, match="division"):
        sync.sync(table, [str(folder)], mark).awaitTermination()
    assert [t for _, _, t in held(table)] == ["one", "two"]

    def dies_after(*a, **b):
        real(*a, **b)
        raise OSError("lost after the commit")

    monkeypatch.setattr(VersionedTable, "_commit", dies_after)
    with pytest.raises(Exception, match="lost after"):
        sync.sync(table, [str(folder)], mark).awaitTermination()
    monkeypatch.undo()
    version = table.latest()
    sync.sync(table, [str(folder)], mark).awaitTermination()  # the batch is known, and given again it changes nothing
    assert held(table) == fresh(spark, folder) and version == 2
    assert table.read().count() == 3


def test_batch_number_is_kept(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, a="one")
    table = VersionedTable(spark, str(tmp_path / "index"))
    now = listing.list_files(spark, [str(folder)])
    assert [sync.reconcile(table, now, ("s", n)) for n in (0, 0, 1)] == [1, 1, 2]


def test_listing_is_spread_by_folders(spark, tmp_path):
    for n in range(6):
        (tmp_path / f"f{n}" / "x" / "y").mkdir(parents=True)
        for name in ("_under.md", ".dot", "plain.txt", "empty"):
            (tmp_path / f"f{n}" / "x" / "y" / name).write_text("" if name == "empty" else "z" * n)
    (tmp_path / "top.txt").write_text("t")
    os.symlink(tmp_path / "f0", tmp_path / "f1" / "loop")
    os.symlink(tmp_path, tmp_path / "f1" / "x" / "up")
    places = listing.spread(list(listing.inputs_of([str(tmp_path)], True)), 5)
    assert len(places) == 7 and not [p for p in places if p.path.endswith((".txt", ".md"))]
    found = listing.list_files(spark, [str(tmp_path), str(tmp_path / "f2"), str(tmp_path / "top.txt")])
    got = sorted((os.path.relpath(r.path, tmp_path), r["size"]) for r in found.collect())
    want = sorted([(f"f{n}/x/y/{m}", 0 if m == "empty" else n) for n in range(6) for m in ("_under.md", ".dot", "plain.txt", "empty")] + [("top.txt", 1)])
    assert got == want and found.schema.simpleString() == "struct<path:string,size:bigint,mtime:timestamp>"
    assert listing.list_files(spark, [str(tmp_path)], recursive=False).count() == 1
    assert listing.list_files(spark, ["/no/such/place"]).count() == 0
    remote = listing.list_files(spark, [f"file://{tmp_path}/f3"]).collect()
    assert sorted(r.path for r in remote) == sorted(f"file://{tmp_path}/f3/x/y/{m}" for m in ("_under.md", ".dot", "plain.txt", "empty"))
