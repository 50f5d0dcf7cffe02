"""Every operator and stage on a table whose other columns have the names of helpers and outputs."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bpe, chat, impact, jaccard, lm, mining, near, packing, quality, secrets, sharding, simhash, topk
from marginalia.llm.dedup import DigestIndex

D = "/root/testdata/sf0.001"
NAMES = """row _row __row0 __ROW1 _spans __spans0 spans base weak kind start end cell fp component component_id late id bucket a b later early rows lead salt
digest batch keep_row keep_id group_size kept code_points best hash _group __group0 length ids ids_crc32 doc_tokens sequence_id offset shard shard1 depth bits bytes cells
word c block held bounds codes logp place score predicted _label y which value conv conv_id pos node tree v vec_id distance slice part rank key n said""".split()
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "d")
    some = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40")
    some.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES))).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


CASES = {
    "encode": lambda s, d: bpe.encode(d, BYTES), "label": lambda s, d: DigestIndex(s, buckets=2).label(d), "assign": lambda s, d: sharding.assign(d, 5000), "scan": lambda s, d: secrets.scan(d), "redact": lambda s, d: secrets.redact(d),
    "lm": lambda s, d: lm.score(d, PIECES), "simhash": lambda s, d: simhash.label(d), "jaccard": lambda s, d: jaccard.label(d), "quality": lambda s, d: quality.score(d, quality.train(d, s.read.parquet(f"{D}/labels.parquet"))),
}


@pytest.mark.parametrize("name", CASES)
def test_a_row_for_each(spark, docs, name):
    assert CASES[name](spark, docs).count() == docs.count()


def test_stages(spark, docs, tmp_path):
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, D)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert out.exceptAll(docs).count() == 0 or name == "secret scans"
    assert simhash.keep(docs).columns == near.keep(docs).columns == docs.columns
    pieces = corpus_pipeline.packed(spark, docs, D)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert packing.pack(packing.token_pieces(docs, WORDS, 4096, 2).withColumns({"_group": F.lit(1), "__group0": F.lit(1), "OFFSET": F.lit(9)})).count() == pieces.count()
    sharding.write(docs, str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_turns_and_vectors(spark):
    turns = spark.read.parquet(f"{D}/conversations.parquet").withColumns({n: F.lit(1) for n in NAMES if n != "conv_id"})
    nodes, paths = chat.format_conversations(turns, BYTES)
    assert paths.count() == turns.count()
    vectors = spark.read.parquet(f"{D}/embeddings.parquet").withColumns({n: F.lit(1) for n in NAMES if n != "vec_id"})
    assert topk.top_k(vectors).count() == 10 * vectors.where("vec_id % 100 = 0").count()
    labelled = spark.read.parquet(f"{D}/embeddings.parquet")
    assert mining.hard_negatives(labelled.withColumns({n: F.lit(1) for n in NAMES if n not in ("vec_id", "label")})).count() == mining.hard_negatives(labelled).count() > 0


def test_items(spark, docs):
    items = spark.read.parquet(f"{D}/benchmark.parquet").withColumns({n: F.lit(1) for n in NAMES})
    assert impact.search(docs, items).exceptAll(impact.search(docs.select("doc_id", "text"), items.select("item_id", "text"))).count() == 0 < impact.search(docs, items).count()
