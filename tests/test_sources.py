import json
import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunk, embed
from marginalia.sources import files, notes, store

VAULT = {
    "plain.md": "plain text",
    "fm_list.md": "---\ntags: [a, b]\n---\nbody #in",
    "fm_str.md": "---\ntags: a, b\n---\nbody",
    "fm_bad.md": "---\ntags: [a, 'b\n---\nbody",
    "fm_open.md": "---\ntags: a\nnever closed",
    "democracy.md": "votes",
    "x.md": "---\ntype: MOC\n---\nlist",
    "y.md": "---\ntags: [Moc]\n---\nlist",
    "AI/sub/n.md": "deep",
    "links.md": "[[a]] [[a|b]] [[a| ]] [[#H]]\n```\n[[code]]\n```\n",
    **{f"e{i}.md": f"level {i} ![[e{i + 1}]]" for i in range(6)},
    "self.md": "me ![[self]]",
    "cycle_a.md": "a ![[cycle_b]]",
    "cycle_b.md": "b ![[cycle_a]]",
    "twice.md": "![[plain]]|![[plain]]",
    "media.md": "![[img]] ![[data.csv]] ![[Note v1.2.md]] ![[nope]] ![[nul]] ![[#h]] ![[sub/n|alias]]\n```\n![[plain]]\n```\n",
    "up/beside.md": "![[near]] ![[../plain.md]]",
    "up/near.md": "beside",
    "img.png": "binary",
    "data.csv": "1,2",
    "Note v1.2.md": "dotted",
    "code.md": "text\n```\nopen",
    "_under.md": "counts",
    ".dot.md": "hidden",
    ".hid/q.md": "hidden",
    "empty.md": "",
    "blank.md": " \n\t",
    "note.txt": "txt",
    "UPPER.TXT": "upper",
}


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in VAULT.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "lat1.md").write_bytes(b"caf\xe9")
    (root / "nul.md").write_bytes(b"a\x00b")
    (root / "ctl.txt").write_bytes(b"\x01" * 10 + b"a" * 90)
    (root / "big.txt").write_bytes(b"a" * 2_000_001)
    (root / "fits.txt").write_bytes(b"a" * 2_000_000)
    return str(root)


def test_listing(spark, vault, tmp_path, monkeypatch):
    names = lambda df: [os.path.relpath(r.path, vault) for r in df.orderBy("path").collect()]
    every = sorted(os.path.relpath(os.path.join(d, f), vault) for d, _, fs in os.walk(vault) for f in fs)
    assert sorted(names(files.list_files(spark, [vault]))) == every
    assert sorted(names(files.list_files(spark, [vault, vault + "/plain.md"]))) == every
    assert sorted(names(files.list_files(spark, [vault], recursive=False))) == [n for n in every if "/" not in n]
    assert files.list_files(spark, ["/no/such/place"]).count() == 0
    monkeypatch.chdir(vault)
    assert names(files.list_files(spark, ["e*.md"])) == [f"e{i}.md" for i in range(6)] + ["empty.md"]


def test_documents_and_report(spark, vault):
    docs, report = files.load_documents(spark, [vault], (".md", ".txt"), vault_root=vault, collection="c")
    (r,) = report.collect()
    total = sum(len(fs) for *_, fs in os.walk(vault))
    counted = {o: r[o] for o in files.OUTCOMES}
    assert r.scanned == total == sum(counted.values())
    assert counted == {"skipped_hidden": 2, "skipped_extension": 2, "skipped_empty": 3, "skipped_too_large": 2, "failed": 0, "loaded": total - 9}
    assert r.by_extension == {".md": total - 12, ".txt": 3}
    rows = {os.path.relpath(d.uri, vault): d for d in docs.collect()}
    assert rows["lat1.md"].text == "café" and rows["fits.txt"].size_bytes == 2_000_000
    assert rows["fm_list.md"].frontmatter_tags == ["a", "b"] == rows["fm_str.md"].frontmatter_tags and rows["fm_list.md"].inline_tags == ["in"]
    assert rows["fm_open.md"].text.startswith("---")
    assert {n for n, d in rows.items() if d.classification == "moc"} == {"democracy.md", "x.md", "y.md"}
    assert rows["links.md"].text == "a b a #H\n```\n[[code]]\n```\n" and rows["links.md"].inline_tags == ["H"]
    assert len({d.doc_id for d in rows.values()}) == len(rows) and rows["plain.md"].collection == "c"
    wrap = lambda n, t: f"\n\n<!-- EMBED: {n} -->\n{t}\n<!-- /EMBED -->\n\n"
    inner = "level 4 !e5"
    for i in (3, 2, 1):
        inner = f"level {i} " + wrap(f"e{i + 1}.md", inner)
    assert rows["e0.md"].text == "level 0 " + wrap("e1.md", inner)
    assert rows["self.md"].text == "me " + wrap("self.md", "me ")
    assert rows["cycle_a.md"].text == "a " + wrap("cycle_b.md", "b " + wrap("cycle_a.md", "a "))
    assert rows["twice.md"].text == wrap("plain.md", "plain text") + "|"
    assert rows["media.md"].text == (
        "\n[Embedded attachment: img.png]\n \n[Embedded file (unsupported type): data.csv]\n " + wrap("Note v1.2.md", "dotted") + "  \n[Embedded note unreadable: nul.md]\n  " + wrap("n.md", "deep") + "\n```\n![[plain]]\n```\n"
    )
    assert rows["up/beside.md"].text == wrap("near.md", "beside") + " " + wrap("plain.md", "plain text")


def test_notes_outside_the_vault(spark, tmp_path):
    for path, text in {"vault/a.md": "inside", "own/n.md": "one ![[a]] ![[m]] ![[o]] two", "own/m.md": "beside", "own/o.md": "other", "own/p.md": "no embeds"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    docs, _ = files.load_documents(spark, [str(tmp_path / "own")], vault_root=str(tmp_path / "vault"))
    got = {r.title: r.text for r in docs.collect()}
    assert got == {"n": "one \n\n<!-- EMBED: a.md -->\ninside\n<!-- /EMBED -->\n\n   two", "m": "beside", "o": "other", "p": "no embeds"}


def test_legacy_notes(spark, vault):
    rows = {r.file_name: r for r in notes.legacy_notes(spark, vault).collect()}
    assert rows["lat1.md"].text == "caf" and rows["n.md"].relative_dir == "AI/sub" and rows["n.md"].is_ai
    assert rows["democracy.md"].classification == "moc" and rows["x.md"].classification == rows["y.md"].classification == "note"
    assert rows["fm_str.md"].frontmatter_tags == "a, b" and rows["links.md"].text.startswith("[[a]]")
    with pytest.raises(FileNotFoundError):
        notes.legacy_notes(spark, "/no/such/vault")


@pytest.mark.parametrize("content, binary", [(b"", False), (b"abc", False), (b"a\x00", True), (b"\x01" * 2 + b"a" * 98, False), (b"\x01" * 3 + b"a" * 97, True), (b"\t\n\r\x0b\x0c\x1f" + b"a" * 94, False), (b"a" * 5000 + b"\x01" * 5000, False)])
def test_binary_sniff(spark, content, binary):
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert df.select(files.looks_binary("c")).first()[0] is binary


def test_index_table_and_interchange(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "some text " * 300), ("d2", "other"), ("d3", "line sep")], "doc_id string, text string")
    rows = embed.dummy(chunk.fixed(docs), dim=8)
    index = store.IndexTable(spark, str(tmp_path / "index"))
    index.save(rows)
    n = rows.count()
    index.append(rows)
    assert index.count() == 2 * n
    index.save(rows)
    newer = index.upsert(rows.where("doc_id = 'd2'").withColumn("text", F.lit("new")), str(tmp_path / "index2"))
    assert newer.count() == n and newer.rows().where("text = 'new'").count() == 1
    store.write_index_jsonl(index.rows(), str(tmp_path / "out"))
    back = store.read_index_jsonl(spark, str(tmp_path / "out"))
    same = ["chunk_id", "doc_id", "chunk_index", "start_char", "end_char", "text", "vector"]
    assert sorted(map(repr, back.select(same).collect())) == sorted(map(repr, index.rows().select(same).collect()))
    (tmp_path / "bad.jsonl").write_text('{"chunk": {"chunk_id": 1}, "vector": [1]}\n\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl, line 2: not json"):
        store.read_index_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    assert store.read_index_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_eval_sets(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid": "1", "query": "q", "relevant_chunk_ids": ["x"]}\n\n{"qid": "2", "query": "r"}\n')
    assert [r.relevant_chunk_ids for r in store.read_eval(spark, str(tmp_path / "a.jsonl")).orderBy("qid").collect()] == [["x"], []]
    (tmp_path / "b.jsonl").write_text('{"query": "q", "expected_files": ["n.md"]}\n')
    assert store.read_legacy_eval(spark, str(tmp_path / "b.jsonl")).first().expected_files == ["n.md"]


def test_cache_and_dumps(spark, tmp_path):
    cache = store.open_cache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, text string")
    out, fresh = embed.cached(docs, cache, embed.dummy, "m", 128)
    assert fresh.count() == 2 and out.where("vector IS NOT NULL").count() == 3
    fresh.write.mode("append").parquet(str(tmp_path / "cache"))
    _, fresh = embed.cached(docs, store.open_cache(spark, str(tmp_path / "cache")), embed.dummy, "m", 128)
    assert fresh.count() == 0
    rows = spark.createDataFrame([(1, 0.5, "f.md", "x" * 700)], "node_id int, score double, file_name string, text string")
    dumped = spark.read.json(store.dump_retrieval("q", rows, str(tmp_path / "dumps"))).first()
    assert dumped.query == "q" and len(dumped.text_preview) == 600
    assert store.retrieval_rows(rows, raw=True).columns == ["score", "source_path", "file_name", "section_heading", "text_preview"]
    said = spark.read.json(store.dump_response("q", "a", rows.select("node_id"), str(tmp_path / "said"))).first()
    assert said.response == "a" and said.citations[0].node_id == 1
    store.append_traces(spark.createDataFrame([("t",)], "trace_id string"), str(tmp_path / "traces"))
    assert spark.read.parquet(str(tmp_path / "traces")).count() == 1
    about = json.loads(store.manifest("i", ["v"], [".txt", ".md"], True, {}, {}, {}, {}))
    assert about["extensions"] == [".md", ".txt"] and about["store"] == "parquet"
    row = spark.createDataFrame([(["b", "a"], datetime(2020, 1, 2), None)], "s array<string>, t timestamp, n string")
    assert json.loads(store.sanitized(row, ("s",)).first().json) == {"s": ["a", "b"], "t": "2020-01-02T00:00:00.000Z", "n": None}


def test_streaming_ingest(spark, vault, tmp_path):
    from marginalia.streaming.ingest import ingest, new_documents

    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b.txt"):
        (folder / name).write_text("text of " + name)
    index, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    ingest(new_documents(spark, str(folder)), index, mark).awaitTermination()
    assert spark.read.parquet(index).count() == 2
    (folder / "c.txt").write_text("later")
    (folder / "d.bin").write_text("no")
    ingest(new_documents(spark, str(folder)), index, mark).awaitTermination()
    got = spark.read.parquet(index)
    assert sorted(re.sub(".*/", "", r.uri) for r in got.collect()) == ["a.txt", "b.txt", "c.txt"]
    assert got.where(F.size("vector") == 128).count() == 3


def test_a_bad_line_has_its_number(spark, tmp_path):
    """Files of several splits, blank lines among them."""
    good = '{"chunk": {"chunk_id": "c", "text": "' + "x" * 500 + '"}, "vector": [1.0]}\n'
    bad = {("one", 1701): "{broken\n", ("one", 3): '{"vector": [1.0]}\n', ("two", 999): "[]\n"}
    for name, n in (("one", 2000), ("two", 1000)):
        (tmp_path / name).write_text("".join(bad.get((name, i), "\n" if i % 7 == 0 else good) for i in range(n)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = store.bad_lines(spark, str(tmp_path))
        assert {(r.file.rpartition("/")[2], r.line): r.snippet + "\n" for r in found.collect()} == bad
        with pytest.raises(ValueError, match=r"one, line 3: \{\"vector"):
            store.read_index_jsonl(spark, str(tmp_path))
        with pytest.raises(Exception, match="not a line of an index"):
            store.read_index_jsonl(spark, str(tmp_path), check=False).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
