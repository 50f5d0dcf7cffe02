"""Calls of models that fail: bounded requests, retries, failures as rows, results kept by key."""

import json
import os
import uuid

import pytest

from marginalia.operators import context, embed
from marginalia.operators.models import Kept, requests, with_model


def test_requests_are_bounded():
    assert list(requests([], 3, 10)) == []
    assert list(requests([1] * 7, 3, 10)) == [(0, 3), (3, 6), (6, 7)]
    assert list(requests([6, 5, 5, 20, 0, 1], 9, 10)) == [(0, 1), (1, 3), (3, 4), (4, 6)]


def counted(folder, every):
    """A function that notes each text that it answers, and fails on every ``every``-th call of its process."""
    calls = [0]

    def length(texts):
        calls[0] += 1
        if calls[0] % every == 0:
            raise ConnectionError("busy")
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        return [[float(len(t))] for t in texts]

    return length


def answered(folder):
    return sorted(t for f in os.listdir(folder) for t in json.load(open(f"{folder}/{f}")))


def test_a_second_run_asks_for_the_rest(spark, tmp_path):
    wanted = spark.createDataFrame([(f"k{i}", "x" * (i + 1)) for i in range(40)] + [("k3", "xxxx"), ("null", None), (None, "y")], "key string, text string").repartition(3)
    kept, noted = Kept(spark, str(tmp_path / "kept"), "array<double>"), tmp_path / "noted"
    noted.mkdir()
    limits = {"items": 1, "tries": 1, "every": 15}
    first = kept.ask(wanted, counted(noted, 3), **limits).collect()
    assert len(first) == 40 and any(r.error for r in first) and all((r.value is None) == (r.error == "ConnectionError: busy") for r in first)
    then = kept.ask(wanted, counted(noted, 1000), **limits).collect()
    assert {r.key: r.value for r in then} == {f"k{i}": [i + 1.0] for i in range(40)} and not any(r.error for r in then) and len(then) == 40
    assert answered(noted) == sorted("x" * (i + 1) for i in range(40))  # each text once
    assert kept.ask(wanted.limit(0), counted(noted, 1)).collect() == []


def test_retries_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "", "ccc", "long" * 9, "a"])], "n int, text string").coalesce(1)
    busy = with_model(rows, counted(tmp_path, 2), "array<double>", items=2, wait=0.0).orderBy("n").collect()
    assert [r.vector for r in busy] == [[1.0], [3.0], None, [0.0], [3.0], [36.0], [1.0]]

    def refuses(texts):
        if "bad" in texts:
            raise ValueError("no such text")
        return [[0.0]] * (len(texts) + ("ccc" in texts))

    told = with_model(rows, refuses, "array<double>", error="why", wait=0.0, tries=2).orderBy("n").collect()
    assert [r.why for r in told] == [None, "ValueError: no such text", None, None, "ValueError: 2 results for 1 rows", None, None]
    assert [r.vector for r in told] == [[0.0], None, None, [0.0], None, [0.0], [0.0]]
    with pytest.raises(Exception, match="a model failed 1 times"):
        embed.by_model(rows, refuses, tries=1).collect()
    with pytest.raises(Exception, match="TypeError|ArrowInvalid"):
        embed.by_model(rows.limit(1), lambda t: ["no vector"] * len(t), tries=1).collect()
    with pytest.raises(ValueError, match="there already"):
        with_model(rows, refuses, "int", out="N")


def test_answers_that_fail(spark):
    asked = spark.createDataFrame([(1, "q", "c"), (2, "fail", "c"), (3, "none", "c"), (4, "q", None)], "qid int, query string, rendered_context string")

    def generate(query, text):
        if query == "fail":
            raise TimeoutError(query)
        return None if query == "none" else " I don't know. "

    got = {r.qid: r for r in context.answer(asked, generate, error="error", tries=1).collect()}
    assert {q: r.answer for q, r in got.items()} == {1: "I don't know.", 2: None, 3: "", 4: None}
    assert got[2].error == "TimeoutError: fail" and got[1].abstained and got[1].error is None
    with pytest.raises(Exception, match="a model failed"):
        context.answer(asked, generate, tries=1).collect()
