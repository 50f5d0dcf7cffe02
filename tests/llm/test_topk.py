import math
import random

import numpy as np
import pytest

from marginalia.llm import registry, topk

from .oracle import same


def brute(rows, k=10, every=100):
    good = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, j, x in good if m != n)
            out += [(i, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    return sorted([tuple(r) for r in topk.top_k(df, **more).collect()], key=str)


@pytest.mark.parametrize("spread", [0.01, 0.3, 5])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_ROWS", 90)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 6) + spread * rng.normal(size=8)).tolist()) for i in range(400)]
    assert run(spark, rows, k=5, every=10, pivots=6) == brute(rows, 5, 10)


def test_bounds_prune():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(4, 8)) * 1000
    x = np.concatenate([c + rng.normal(size=(100, 8)) for c in centres])
    cells = topk.Cells(centres, 5)
    cell, d = cells.place(x)
    for i in range(4):
        cells.queries[i], cells.radius[i] = 10, d[cell == i].max()
    cells.bound([np.sort(d[cell == i])[:6].tolist() for i in range(4)])
    assert cells.wanted(x).mean() < 0.6


def test_copies():
    """Rows far from all queries of a group stay away from it; no row has more copies than there are groups."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 8)) * 1000
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in centres])).astype(np.int64)
    cells = topk.Cells(centres, 5)
    cell, d = cells.place(x)
    for i in range(8):
        cells.queries[i], cells.radius[i] = 10, d[cell == i].max()
        own = x[cell == i]
        cells.reached[i] = topk.best_scores(topk.products(own[:10], own), 6).min()
    cells.grouped(20)
    assert len(cells.starts) == 4 and cells.parts.tolist() == [1] * 4 and sorted(cells.order) == list(range(8))
    at, group = cells.sent(x)
    assert len(at) < 0.4 * 4 * len(x)
    want = cells.wanted(x)
    assert set(zip(at.tolist(), group.tolist())) == {(n, int(cells.group[c])) for n, c in zip(*np.nonzero(want))}
    cells.queries[:] = [50, *[1] * 7]
    cells.grouped(20)
    assert cells.parts.max() == 3


@pytest.mark.parametrize("pivots", [None, 3])
def test_clusters_and_hot_cells(spark, monkeypatch, pivots):
    monkeypatch.setattr(topk, "TILE_QUERIES", 5)
    monkeypatch.setattr(topk, "TILE_ROWS", 60)
    monkeypatch.setattr(topk, "OWN", 20)
    rng = np.random.default_rng(13)
    rows = [(i, (rng.normal(size=4) * 0.02 + (i % 3 == 0) * 3.0).tolist()) for i in range(300)] + [(1000 + i, [3.0, 3.0, 3.0, 3.0]) for i in range(150)]
    assert run(spark, rows, k=4, every=5, pivots=pivots) == brute(rows, 4, 5)


def test_edge_rows(spark):
    rng = random.Random(11)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [3.0, 1.0]), (100, [0.5]), (200, [])]
    rows += [(7, [1.0, 1.0])] * 30 + [(i, [rng.choice([0.0, 1.0, -1.0]), 1.0]) for i in range(300, 360)]
    want = [(i, [*(v or []), 0.0, 0.0][:2] if v is not None else None) for i, v in rows]
    assert run(spark, rows) == brute(want)
    assert run(spark, []) == []
    assert run(spark, rows[:2] + rows[7:8]) == brute(want[:2] + want[7:8])


def test_large_components_are_exact():
    a, b = np.array([[2**31 + 1, 3]]), np.array([[2**31 - 1, 5], [7, 11]])
    assert topk.products(a, b).tolist() == [[(2**31 + 1) * (2**31 - 1) + 15, (2**31 + 1) * 7 + 33]]


def test_query_against_sql(spark):
    assert same(spark, registry.op10_topk, registry.OP10_SQL, "/root/testdata/sf0.01") == 50
