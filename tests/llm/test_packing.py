import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from marginalia.llm import packing, registry

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_first_fit(lengths, limit):
    room, bins, offsets = [], [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), None)
        if b is None:
            b = len(room)
            room.append(limit)
        bins.append(b)
        offsets.append(limit - room[b])
        room[b] -= n
    return bins, offsets


def test_first_fit_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randrange(0, 30))), reverse=True)
        assert packing.first_fit(np.array(lengths, int), 20) == brute_first_fit(lengths, 20)


def whole(rows, limit):
    """Check every rule of packing; return the ids of each (doc_id, document)."""
    bins = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= limit
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_pieces_hold_each_id_once(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "Hello World", "it's ΑΣ ΑΣΑ", "a　b\x1cc\x85d", "x<|endoftext|>y", "é é", "<|ENDOFTEXT|> A", "É, É. ñ., s. x's, Ab.c, ,. A1. ß, ÀÉ,", "word " * 900, "z" * 3000] + [
        " ".join(rng.choice(["foo", "Bar!", "日本", "12", "don't"]) for _ in range(rng.randrange(80))) for _ in range(100)
    ]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "abc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = packing.pack(packing.token_pieces(docs, PATH, limit=64), limit=64, group_pieces=40).collect()
    whole(got, 64)
    lib = Tokenizer.from_file(PATH)
    parts = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        parts[r.doc_id].append(r)
    for i, t, _ in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(parts[i], key=lambda r: r.start)
        if i == 5:
            own = own[::2]
        assert [x for r in own for x in r.ids] == want
        assert all(r.doc_tokens == len(want) for r in own)


class Counting:
    """The library, which counts the texts that it is handed."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_words_are_handed_over_together_and_once(monkeypatch):
    words = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(150_000)]
    known = packing.WordIds(PATH)
    known.library = counting = Counting(known.library)
    monkeypatch.setattr(packing, "word_ids", lambda path: known)
    for _ in range(2):
        for lo in range(0, len(words), 10_000):
            packing.tokenise(pa.array([" ".join(words[lo : lo + 10_000]) + "."]), PATH)
    assert counting.texts < 100


def test_words_against_library(monkeypatch):
    rng = random.Random(6)
    lib = Tokenizer.from_file(PATH)
    alphabet = ["a", "B", "é", "Ö", "ß", "÷", "×", "ª", "'", "s", ",", ".", "1", "e\u0301", "\u0301", "İ", "日", "<|", "|>", "\x1c", "</w>"]
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(30)) for _ in range(300)]
    texts += [None, "", ",", ".", ". ,", "a,. b.,", "É", "e\u0301 \u0301a", "a <|endoftext|> b.", "abc " * 50]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]

    def check(kind):
        ids = []
        for lo in range(0, len(texts), 40):
            flat, at = packing.tokenise(pa.array(texts[lo : lo + 40], kind), PATH)
            ids += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        assert ids == want

    packing.word_ids.cache_clear()
    check(pa.string())
    check(pa.large_string())
    monkeypatch.setattr(packing, "MEMO_BYTES", 2000)  # full after each block
    check(pa.string())
    packing.word_ids(PATH).ends_word[:] = False  # a vocabulary without marks
    check(pa.string())
    packing.word_ids.cache_clear()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def test_query_has_little_padding(spark):
    d = "/root/testdata/sf0.01"
    rows = registry.op3_packing(spark, d).collect()
    bins = whole(rows, 4096)
    used = sum(r.length for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    assert used / (4096 * len(bins)) > 0.99
    lib = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 50 = 0").collect()}
    for r in rows:
        if r.doc_id in text:
            ids = np.array(lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
