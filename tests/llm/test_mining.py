import math
import random

import numpy as np
import pytest

from marginalia.llm import mining, registry

from .oracle import same


def brute(rows, k=5, positives=5, every=100, scale=256, low=80, high=100):
    good = [(n, i, [math.floor(scale * x) for x in v], y) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q, y in good:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, m, z) for m, j, x, z in good if m != n)
        for s, none, j, _, _ in [x for x in scored if x[4] == y][:positives]:
            fit = [x for x in scored if x[4] != y and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, None if none else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(fit[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, score int").repartition(3)
    return sorted([tuple(r) for r in mining.hard_negatives(df, **more).collect()], key=str)


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(mining, "ANCHORS", 7)
    monkeypatch.setattr(mining, "ROWS", 60)
    monkeypatch.setattr(mining, "CHUNK", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + spread * rng.normal(size=8)).tolist(), int(rng.integers(0, 3)) if i % 3 else 0) for i in range(300)]
    want = brute(rows, 3, 4, 10)
    assert run(spark, rows, k=3, positives=4, every=10) == want and want


def test_edge_rows(spark):
    rng = random.Random(4)
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, None, 1), (200, [None, 1.0], 1), (300, [math.nan, 1.0], 2), (400, [1.0, 1.0], None), (None, [3.0, 1.0], 1), (500, [0.0, 0.0], 1), (600, [-1.0, 0.5], 3)]
    rows += [(7, [1.0, 1.0], 2)] * 12 + [(i, [rng.choice([0.0, 1.0, -1.0]), 1.0], rng.choice([1, 2, 3])) for i in range(701, 760)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:2]) == []


def test_intervals_drop():
    """Rows out of the window go before the last planes, whatever k is."""
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, size=(500, 16))
    planes = mining.Planes(x, 8, 200)
    seen = []
    planes.planes = [type("Seen", (), {"T": p.T, "__getitem__": lambda s, rows, p=p: seen.append(len(rows)) or p[rows]})() if i >= mining.DENSE else p for i, p in enumerate(planes.planes)]
    q = rng.integers(-200, 200, size=16)
    exact = x @ q
    low, high = np.array([int(np.quantile(exact, 0.5))]), np.array([int(np.quantile(exact, 0.55))])
    (found,) = list(planes.best(q[None], np.ones((1, 500), bool), [low], [high], 500, np.arange(500)))
    assert sorted(found[2].tolist()) == np.flatnonzero((exact >= low) & (exact <= high)).tolist()
    assert seen == sorted(seen, reverse=True) and seen[-1] < 60 < seen[0]


def test_overflow_raises(spark):
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 2)])


def test_query_against_sql(spark):
    assert same(spark, registry.op11_hard_negatives, registry.OP11_SQL, "/root/testdata/sf0.01") > 50
