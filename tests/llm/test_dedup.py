import hashlib
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import registry
from marginalia.llm.dedup import DigestIndex, buckets_for
from marginalia.sources.versions import ConcurrentWrite, create_once


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(rows):
        s = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[s])
        out.append((i, None if best[1] else best[2], len(groups[s]), hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str), sum(1 for _ in groups)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b\tc"), (4, "a\x0bb\x0c\r\nc "), (5, None), (6, ""), (7, " \n"), (None, "abc"), (None, None),
    (8, "é x"), (9, "éx"), (9, "éx"), (10, "a\xa0b"), (11, "ab"), (12, "long " * 20000), (13, "long" * 20000), (14, "abc" + " " * 50), (3, "a  b\tc"),
]


def test_label_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, digest string").repartition(3)
    got = DigestIndex(spark, buckets=4).label(docs).collect()
    want, groups = brute(ROWS)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_later_batches_and_reopening(spark):
    first = DigestIndex(spark, buckets=4)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    first.label(docs)
    again = DigestIndex(spark, first.path, buckets=4)
    size = again.rows().count()
    new = spark.createDataFrame([(100, "abc"), (101, "new"), (102, "n ew")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in again.label(new).collect()}
    assert got == {100: (14, False, 1), 101: (102, False, 2), 102: (102, True, 2)}
    assert again.rows().count() == size + 1


def test_a_batch_given_again(spark, tmp_path):
    """The same batch id gets the same answer, another one finds all texts known."""
    index = DigestIndex(spark, buckets=4)
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    answers = [sorted(map(str, index.keep(docs, batch="one").collect())) for _ in range(2)]
    assert answers[0] == answers[1] and len(answers[0]) == brute(ROWS)[1] == index.rows().count()
    assert sorted(map(str, index.label(docs, batch="one").collect())) == sorted(map(str, DigestIndex(spark, buckets=4).label(docs).collect()))
    assert index.keep(docs, batch="two").count() == 0


def test_bucket_count_is_kept(spark):
    first = DigestIndex(spark, buckets=8)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    first.label(docs)
    first.close()
    with pytest.raises(ValueError, match="8 buckets"):
        DigestIndex(spark, first.path, buckets=4)
    again = DigestIndex(spark, first.path)
    assert again.buckets == 8 and again.keep(docs).count() == 0
    again.close()
    assert not spark.catalog.tableExists(again.name)


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_other_ids(spark, kind):
    docs = spark.createDataFrame([(f"2020-01-0{i}" if kind == "date" else str(i), t) for i, t in ((1, "a"), (2, "a "), (3, "b"))], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    index = DigestIndex(spark, buckets=2)
    index.label(docs)
    ids = {str(r.doc_id): (str(r.keep_id), r.kept) for r in index.label(docs).collect()}
    a, b, c = sorted(ids)
    assert ids == {a: (b, False), b: (b, False), c: (c, False)} and index.label(docs).schema["keep_id"].dataType == docs.schema["doc_id"].dataType


def test_keep_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, __ROW0 long")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = DigestIndex(spark, buckets=4).keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute(ROWS)[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert DigestIndex(spark, buckets=4).label(docs).count() == 0


def test_index_layout(spark):
    index = DigestIndex(spark, buckets=4)
    index.label(spark.createDataFrame(ROWS, "doc_id long, text string"))
    about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert about["Num Buckets"] == "4" and "digest" in about["Bucket Columns"] and "digest" in about["Sort Columns"]


def texts(spark, lo, hi):
    return spark.createDataFrame([(i, f"text {i}") for i in range(lo, hi)], "doc_id long, text string")


def test_many_batches_are_compacted(spark):
    """Files of a bucket stay bounded, and answers are those of an index that was never compacted."""
    index, plain = DigestIndex(spark, buckets=2, most_files=3), DigestIndex(spark, buckets=2, most_files=1000)
    for n in range(10):
        docs = texts(spark, 20 * n, 20 * n + 30)
        got = [sorted((r.doc_id, r.keep_id, r.kept, r.group_size) for r in i.label(docs, batch=str(n)).collect()) for i in (index, plain)]
        assert got[0] == got[1] and sum(kept for _, _, kept, _ in got[0]) == (30 if n == 0 else 20)
        assert len(index.rows().inputFiles()) <= 3 * 2
    assert index.generation > 1 and plain.generation == 0
    assert sorted(index.rows().collect()) == sorted(plain.rows().collect()) and index.rows().count() == 210
    again = sorted(map(str, index.label(texts(spark, 180, 210), batch="9").collect()))
    assert again == sorted(map(str, plain.label(texts(spark, 180, 210), batch="9").collect()))


def test_opened_before_another_compacts(spark):
    first = DigestIndex(spark, buckets=2)
    first.label(texts(spark, 0, 10))
    other = DigestIndex(spark, first.path)
    other.compact()
    other.label(texts(spark, 10, 20))
    assert first.keep(texts(spark, 0, 25)).count() == 5
    assert first.generation == other.generation == 1


def test_a_compaction_that_was_killed_does_not_count(spark):
    index = DigestIndex(spark, buckets=2)
    index.label(texts(spark, 0, 10))
    index.rows().where("false").write.parquet(index._folder(1))
    index.rows().limit(3).write.mode("append").parquet(index._folder(1))
    again = DigestIndex(spark, index.path)
    assert again.rows().count() == 10
    again.compact()
    assert sorted(again.rows().collect()) == sorted(index.rows().collect()) and len(again.rows().inputFiles()) == 2


def test_one_writer_at_a_time(spark):
    index = DigestIndex(spark, buckets=2)
    index.label(texts(spark, 0, 10), batch="one")
    assert create_once(spark, f"{index.path}.writer", "killed")
    with pytest.raises(ConcurrentWrite, match="killed"):
        index.label(texts(spark, 0, 20), batch="two")
    assert index.rows().count() == 10
    assert index.keep(texts(spark, 0, 15), batch="killed").count() == 5  # its own batch takes it over
    assert index.keep(texts(spark, 0, 20), batch="two").count() == 5
    assert create_once(spark, f"{index.path}.writer", "killed")
    index.release()
    assert index.keep(texts(spark, 0, 20)).count() == 0


def test_plan_meets_the_index_once_and_in_order(spark):
    """One scan of the index by a sort-merge join; after compaction its side is neither shuffled nor sorted."""
    index = DigestIndex(spark, buckets=2)
    index.label(texts(spark, 0, 10))
    index.compact()
    index.spark.range(10).selectExpr("sha2(string(id), 256) AS digest").write.parquet(f"{index.path}-groups")
    with index._in_order():
        plan = index._met(spark.read.parquet(f"{index.path}-groups"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("FileScan") == 2
    assert len(re.findall(r"\bSort \[", plan)) == 1 and plan.count("Exchange") == 1


def test_bucket_numbers():
    assert buckets_for(0) == 64 and buckets_for(64_000_001) == 65 and buckets_for(10**12) == 100_000


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = registry.op2_exact_dedup(spark, d).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)[0]


def test_query_against_sql(spark):
    from .oracle import same

    assert same(spark, registry.op2_exact_dedup, registry.OP2_SQL, "/root/testdata/sf0.001") > 0
