"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import near, packing, quality, secrets
from marginalia.llm.common import table
from marginalia.llm.dedup import DigestIndex, buckets_for
from marginalia.plans.staging import stage

SEQUENCE, END_ID = 4096, 2
#: SQL can express neither fitting the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    index = DigestIndex(spark, buckets=buckets_for(docs.count()))
    kept = index.keep(docs)
    index.close()
    return kept


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles that are 0.8 alike) the document with the smallest id stays."""
    return near.keep(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens, in sequences: a row per piece with its place and its ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), limit=SEQUENCE, end_id=END_ID)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", no_near_copies),
    ("secret scans", no_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
