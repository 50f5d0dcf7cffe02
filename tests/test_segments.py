"""Cuts at fences against a walk over lines, for odd line ends, fences without end and very long texts."""

import random

from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.sources import notes


def test_segments_against_lines(spark):
    rng = random.Random(5)
    alphabet = ["```", "```", "`", "\n", "\n", "\r", "\r\n", " ", "\t", "\x0b", "\x0c", "\x1e", "\x1f", "\x85", "\xa0", " ", "a", "é", "😀"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["line of words\n" * 200_000, " \n" * 200_000, "```\nx\n" * 20_001, "x" * 2_000_000 + "\n```", " " * 500_000 + "```"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", md.segments("t").alias("s"))
    for r in rows.repartition(8).collect():
        assert [tuple(p) for p in r.s] == list(notes.fenced(texts[r.n])), texts[r.n][:80]
    assert spark.range(1).select(md.segments(F.lit(None).cast("string")).alias("s")).first().s is None
