import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_merge(symbols, ranks, merged, width):
    symbols = list(symbols)
    while True:
        found = [(ranks[a * width + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a * width + b in ranks]
        if not found:
            return symbols
        r, i = min(found)
        symbols[i : i + 2] = [merged[r]]


def test_merge_against_brute_force():
    rng = random.Random(1)
    width = 40
    pairs = rng.sample([(a, b) for a in range(20) for b in range(20)], 60)
    ranks = {a * width + b: r for r, (a, b) in enumerate(pairs)}
    merged = [rng.randrange(40) for _ in pairs]
    for _ in range(500):
        word = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        assert bpe.merge(list(word), ranks, merged, width) == brute_merge(word, ranks, merged, width)


def test_forest_against_brute_force():
    rng = random.Random(5)
    width = 42
    pairs = rng.sample([(a, b) for a in range(20) for b in range(20)], 80)
    ranks = {a * width + b: r for r, (a, b) in enumerate(pairs)}
    merged = [rng.randrange(20) for _ in pairs]
    byte_ids = [b % 20 for b in range(256)]
    forest = bpe.Forest(ranks, merged, byte_ids, width)
    for most in (1, 2, 3, 4, 8, 9, 70):
        words = [bytes(rng.randrange(256) for _ in range(rng.randint(1, most))) for _ in range(100)]
        ids, counts = forest.merge(words)
        want = [brute_merge([byte_ids[b] for b in w], ranks, merged, width) for w in words]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


class Caught:
    """Stands for a DataFrame and gives the function that its tasks would run."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema = spark, schema

    def mapInArrow(self, run, schema):
        return run


def test_new_words_of_a_block_are_merged_together(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [None, " ".join(words[:2000]), "", "<|endoftext|>".join(words[1000:]), "z" * 500]
    single, alone = bpe.merge, []
    monkeypatch.setattr(bpe, "merge", lambda symbols, *rest: alone.append(len(symbols)) or single(symbols, *rest))
    bpe.vocabulary.cache_clear()
    run = bpe.encode(Caught(spark, spark.createDataFrame([], "text string").schema), PATH)
    got = [ids for batch in run(iter([pa.RecordBatch.from_pydict({"text": texts})])) for ids in batch.column("ids").to_pylist()]
    bpe.vocabulary.cache_clear()
    lib = Tokenizer.from_file(PATH)
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert alone == [500]


@pytest.mark.parametrize("words, chars", [(100, 64), (1 << 18, 3)])
def test_memo_that_is_full_or_knows_short_words_only(monkeypatch, words, chars):
    monkeypatch.setattr(bpe, "MEMO_WORDS", words)
    monkeypatch.setattr(bpe, "MEMO_CHARS", chars)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abé1'st ") for _ in range(rng.randrange(8))) for _ in range(90)) for _ in range(12)]
    lib = Tokenizer.from_file(PATH)
    known, flat = bpe.Vocabulary(PATH), bpe.array("i")
    for lo in range(0, 12, 3):
        start = len(flat)
        ends = known.encode_all(texts[lo : lo + 3], flat)
        assert ends[0] == start and [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 3]]


TEXTS = [
    None, "", " ", "a", "Hello, world!  it's\n\n\tfine", "x" * 5000, "ab" * 3000, "é" * 99, "日本語 テキスト", "a<|endoftext|>b <|endoftext|>",
    "<|endoftext|", "՘₏ ok", "emoji 👩‍👩‍👧 \U0001f600", "\x00\x01\x1c\x85\xa0", "don't we'll", "   lead", "trail   ", "1234 5678", "á",
]


@pytest.mark.parametrize("copies", [1, 3])
def test_ids_and_round_trip(spark, copies):
    rng = random.Random(2)
    texts = TEXTS * copies + ["".join(rng.choice("ab é\n'st1<|>endofx日") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i if i % 7 else None, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "n long, text string, IDS string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH) if copies == 1 else bpe.encode(docs, PATH, decoded="decoded")
    assert got.columns == ["n", "text", "ids", "decoded"]
    lib = Tokenizer.from_file(PATH)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want
        assert r.decoded == lib.decode(want, skip_special_tokens=False) == (r.text or "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0


def test_query_against_library(spark):
    import hashlib

    from marginalia.llm import registry

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.op1_bpe(spark, d).collect()}
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
