import random
import re

import pytest

import corpus_pipeline
from marginalia.llm import jaccard, near


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) > 0


def check(docs, stays):
    """No two rows that stay are near, and each other row has a chain of near ones to one that stays."""
    sets = {r.doc_id: brute_set(r.text) for r in docs.collect()}
    near_by = {i: [j for j in sets if j != i and alike(sets[i], sets[j])] for i in sets}
    assert not [(i, j) for i in stays for j in near_by[i] if j in stays]
    reached, more = set(), set(stays)
    while more:
        reached |= more
        more = {j for i in more for j in near_by[i]} - reached
    assert reached == sets.keys()


def test_near_copies_beyond_two_bits_go(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(5000))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        for changes in (0, 1, 2, 3, 4):
            text = list(base)
            for at in rng.sample(range(120), changes):
                text[at] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    stays = {r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()}
    check(docs, stays)


def test_texts_with_like_fingerprints_stay(spark, tmp_path):
    """Texts at about 0.6 stay, though some of their fingerprints differ in two bits at most."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for n in range(200):
        text = list(base)
        for at in rng.sample(range(200), 5):
            text[at] = f"x{n}-{at}"
        rows.append((n, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    check(docs, {r.doc_id for r in near.keep(docs).collect()})


def test_a_large_group_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(60), rng.randrange(6)):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    check(docs, {r.doc_id for r in near.keep(docs).collect()})


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, tmp_path, n):
    rows = [(None, None)] * n + [(None, "one")] * n + [(3, "One")] * n
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = near.keep(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(str(r.text) for r in got) == ["None", "One"][: 2 * n]
