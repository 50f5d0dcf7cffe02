import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import near, quality, simhash
from marginalia.plans.staging import stage

from .test_near import alike, brute_set
from .test_secrets import brute as brute_secrets
from .test_simhash import brute_fingerprint

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, D), "test")
        out.append(docs.collect())
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_quality_stage(spark, outputs):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in outputs[1]} == good and 0 < len(good) < len(outputs[0])


def test_exact_stage(outputs):
    best = {}
    for r in outputs[1]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 0)), (-len(r.text), r.doc_id)) if key in best else (-len(r.text), r.doc_id)
    assert {r.doc_id for r in outputs[2]} == {i for _, i in best.values()}


def test_near_stage(outputs):
    """Five-word shingles, similarity 0.8: no near pair stays, and what goes is near, or two bits from, an earlier document."""
    rows = sorted(outputs[2], key=lambda r: r.doc_id)
    sets, prints = [brute_set(r.text) for r in rows], [brute_fingerprint(r.text) for r in rows]
    stays = {r.doc_id for r in outputs[3]}
    linked = set()
    for j in range(len(rows)):
        for i in range(j):
            near = min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j])
            assert not (near and rows[i].doc_id in stays and rows[j].doc_id in stays)
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                linked.add(rows[j].doc_id)
    assert 0 < len(rows) - len(stays) <= len(linked) and {r.doc_id for r in rows} - stays <= linked


def test_secret_stage(outputs):
    before = {r.doc_id: r for r in outputs[3]}
    assert before.keys() == {r.doc_id for r in outputs[4]}
    for r in outputs[4]:
        assert not brute_secrets(r.text)[1] and r.n_chars == len(r.text)
        if not brute_secrets(before[r.doc_id].text)[1]:
            assert r == before[r.doc_id]


def test_packing_stage(outputs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts, bins = defaultdict(list), defaultdict(int)
    for r in outputs[5]:
        parts[r.doc_id].append((r.start, r.ids))
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096
    for r in outputs[4]:
        assert [x for _, ids in sorted(parts[r.doc_id]) for x in ids] == lib.encode(r.text, add_special_tokens=False).ids + [2]


def test_rows_of_a_null_id(spark, tmp_path):
    rows = [(None, "plain text of some words here", "en", "s", None), (None, "plain text of some words here", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert simhash.keep(docs).count() == 2
    apart = [(i, f"{w} " * 3 + " ".join(f"{w}{n}" for n in range(40)), "en", "s", 0) for i, w in ((None, "a"), (None, "b"), (None, "c"), (5, "d"), (5, "e"))]
    spark.createDataFrame(apart + apart[:2] + apart[4:], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "e"))
    for keep in (simhash.keep, near.keep):
        assert sorted(map(str, keep(spark.read.parquet(str(tmp_path / "e"))).collect())) == sorted(map(str, spark.createDataFrame(apart, docs.schema).collect()))
    for _, function in corpus_pipeline.STAGES:
        for input_ in (docs, docs.limit(0)):
            function(spark, input_, D).collect()
