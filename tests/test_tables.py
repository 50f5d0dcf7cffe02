"""Table functions in SQL against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunk, context
from marginalia.plans import tables


@pytest.fixture()
def rows(spark):
    tables.register(spark)
    some = spark.range(600).select(
        (F.col("id") % 5).alias("qid"), F.format_string("c%04d", "id").alias("chunk_id"), F.round(F.pmod(F.col("id") * 37, F.lit(101)) / 101, 3).alias("score"),
        F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.concat(F.lit("Some  text "), (F.col("id") % 90).cast("string"), F.repeat(F.lit("é"), (F.col("id") % 13 * 20).cast("int")))).alias("text"),
    )
    some.createOrReplaceTempView("packable")
    return some


@pytest.mark.parametrize("budget, most", [(1800, 12), (150, 12), (100_000, 40), (3, 5), (400, 0)])
def test_pack_in_sql(spark, rows, budget, most):
    columns = ["qid", "chunk_id", "rank", "cost", "used"]
    got = spark.sql(f"SELECT * FROM pack_context(TABLE(packable) PARTITION BY qid ORDER BY (score DESC, chunk_id), budget => {budget}, max_chunks => {most})")
    assert got.columns == [*rows.columns, "rank", "cost", "used"]
    want = context.pack(rows, budget, most)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_pack_of_nothing_and_of_wrong_tables(spark, rows):
    assert spark.sql("SELECT * FROM pack_context(TABLE(SELECT * FROM packable WHERE false) PARTITION BY qid ORDER BY score DESC)").collect() == []
    for query, told in [("SELECT * FROM pack_context(TABLE(SELECT qid FROM packable) PARTITION BY qid)", "lacks"), ("SELECT * FROM pack_context(TABLE(SELECT *, 1 AS rank FROM packable) PARTITION BY qid)", "there already")]:
        with pytest.raises(Exception, match=told):
            spark.sql(query).collect()


def test_header_chunks_in_sql(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a", "# One\n" + "word " * 700 + "\n## Two\nshort"), ("b", ""), ("c", None), ("d", "plain")], "doc_id string, text string")
    docs.createOrReplaceTempView("headed")
    got = spark.sql("SELECT * FROM chunk_headers(TABLE(headed), size => 300, overlap => 40)")
    want = chunk.by_headers(docs, 300, 40)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
