"""Folders by the hundred, files written by tasks, and the queries over both."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia import registry
from marginalia.plans.staging import shared_dir
from marginalia.sources import files, listing

from .oracle import TABLES, same

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The tables, with some ids of documents twice."""
    root = tmp_path_factory.mktemp("tables")
    for t in set(TABLES) - {"documents"}:
        os.symlink(f"{D}/{t}.parquet", root / f"{t}.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.union(docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("again "), "text"))).coalesce(1).write.parquet(str(root / "made"))
    (part,) = (root / "made").glob("*.parquet")
    os.symlink(part, root / "documents.parquet")
    return str(root)


def test_tasks_do_not_follow_folders(spark, tmp_path):
    """Wide at the top, and wide below a narrow beginning."""
    want = []
    for top in ("", "a/b/c/d/e/"):
        for n in range(150):
            (tmp_path / f"{top}f{n}" / "x").mkdir(parents=True)
            for m in range(n % 3):
                (tmp_path / f"{top}f{n}" / "x" / f"_{m}").write_text("z" * n)
                want.append((f"{top}f{n}/x/_{m}", n))
    for inputs in ([str(tmp_path)], [str(tmp_path / f"f{n}") for n in range(150)] + [str(tmp_path / "a")]):
        begun = listing.Scan(list(listing.inputs_of(inputs, True)))
        assert len(begun.partitions()) <= listing.FOLDERS
        found = listing.list_files(spark, inputs)
        assert sorted((os.path.relpath(r.path, tmp_path), r["size"]) for r in found.collect()) == sorted(want)
    first = listing.opened(listing.inputs_of([str(tmp_path)], True), 5)
    assert sum(1 for p in first if p.deep) == 151


def test_links_that_lead_nowhere(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_text("a")
    for top in (tmp_path, tmp_path / "f"):
        os.symlink("self", top / "self")
        os.symlink("none", top / "broken")
    os.symlink("f/a", tmp_path / "again")
    assert [r.path for r in listing.list_files(spark, [str(tmp_path)]).collect()] == [str(tmp_path / "f" / "a")]


def test_a_file_per_row(spark, tmp_path):
    rows = [("a", "one"), ("a", "two\nlines"), ("b/c", "é"), ("b/c", None), ("d", "")] * 3
    files.write_texts(spark.createDataFrame(rows, "folder string, text string").repartition(3), f"file://{tmp_path}/in")
    files.mark_written(f"file://{tmp_path}/in")
    made = [(d, f) for d, _, names in os.walk(tmp_path) for f in names]
    assert ((str(tmp_path / "in"), "_SUCCESS")) in made and len(made) == 16
    got = Counter((os.path.relpath(d, tmp_path / "in"), open(f"{d}/{f}", "rb").read()) for d, f in made if f != "_SUCCESS")
    assert got == Counter((f, ((t or "") + "\n").encode()) for f, t in rows)


def test_files_listed_with_repeated_ids(spark, repeated):
    assert same(spark, registry.files_listed, registry.ORACLES["files_listed"], repeated) == 221


def test_ingest_files_with_repeated_ids(spark, repeated):
    assert same(spark, registry.ingest_files, registry.ORACLES["ingest_files"], repeated) == 220


def test_reading_is_spread(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    read = files.read_bytes(listing.list_files(spark, [str(tmp_path)])).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.content.decode() for r in read) == sorted(f"text {n}" for n in range(40)) and len({r.task for r in read}) == 4


def test_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """Every order of small and large, of unread and missing files gives each row its own content."""
    monkeypatch.setattr(files, "BLOCK_BYTES", 100)
    sizes = [0, 60, 60, 300, 1, 99, 2000, 100, 5]
    rows = [(str(tmp_path / f"{n}"), size) for n, size in enumerate(sizes)]
    for path, size in rows[:-1]:
        with open(path, "wb") as f:
            f.write(bytes([len(path) % 7]) * size)
    got = {r.path: (r["size"], r.content, r.error) for r in files.read_bytes(spark.createDataFrame(rows, "path string, size long"), 1000).collect()}
    assert {p: s for p, (s, _, _) in got.items()} == dict(rows)
    assert [None if got[p][1] is None else len(got[p][1]) for p, _ in rows] == [0, 60, 60, 300, 1, 99, None, 100, None]
    assert [p for p, _ in rows if got[p][2]] == [rows[-1][0]] and "FileNotFoundError" in got[rows[-1][0]][2]


def test_no_notes(spark, tmp_path):
    """The same columns as with notes, and nothing staged is left beside the result."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain")
    (tmp_path / "in" / "empty.py").write_text("")
    there = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    docs, report = files.load_documents(spark, [str(tmp_path / "in")], collection="c")
    assert [n.partition("-")[0] for n in set(os.listdir(shared_dir(spark).removeprefix("file://"))) - there] == ["judged"]
    (r,), (d,) = report.collect(), docs.collect()
    assert (r.scanned, r.loaded, r.skipped_empty, r.by_extension) == (2, 1, 1, {".txt": 1})
    assert d.text == "plain" and d.title == "a" and [d.frontmatter, d.frontmatter_tags, d.inline_tags, d.classification] == [None] * 4
    (tmp_path / "in" / "n.md").write_text("---\ntags: [x]\n---\nnote #y")
    more, _ = files.load_documents(spark, [str(tmp_path / "in")], collection="c")
    assert more.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(repr, more.where("ext = '.txt'").collect())) == sorted(map(repr, [d]))
