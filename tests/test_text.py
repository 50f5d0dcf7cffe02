import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx

ALPHABET = "ab A.!?\n\t\x0b\x1c\x85\xa0 　é,#"


def column(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def texts(n=400, seed=0):
    rng = random.Random(seed)
    return ["", " ", "x"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_white_space_is_that_of_python():
    assert set(tx.WS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_signature_tokens(spark):
    rows = texts()
    got = column(spark, [(t,) for t in rows], "t string", s=tx.strip("t"), g=tx.signature("t"), n=tx.token_estimate("t"), q=tx.quote("t", 3))
    for t, r in zip(rows, got):
        assert r == {"s": t.strip(), "g": " ".join(t.lower().split())[:500], "n": max(1, len(t) // 4), "q": t[:3]}


def best(query, text, most=260):
    words = lambda s: {w.lower() for w in re.findall(r"[A-Za-z0-9_/-]+", s)}
    parts = re.split(r"(?<=[.!?])\s+", text)
    found = max(parts, key=lambda s: len(words(s) & words(query))).strip()
    return found[: most - 1] + "…" if len(found) > most else found


def test_best_sentence(spark):
    rows = texts(300, 1) + ["a. " + "b" * 400]
    got = column(spark, [(t,) for t in rows], "t string", s=tx.best_sentence(F.lit("a b A aa"), "t"))
    assert [r["s"] for r in got] == [best("a b A aa", t) for t in rows]


@pytest.mark.parametrize("text, want", [("I DON'T know", True), ("Not enough information.", True), ("i don’t know", False), ("", False)])
def test_abstained(spark, text, want):
    assert column(spark, [(text,)], "t string", a=tx.abstained("t")) == [{"a": want}]


def test_cache_key_tells_dimensions_apart(spark):
    (r,) = column(spark, [("x",)], "t string", a=tx.cache_key("m", "t"), b=tx.cache_key("m", "t", 8), c=tx.cache_key("m", "t", 9))
    assert len(set(r.values())) == 3
