import math
import re
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import impact, registry

from .oracle import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    found = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in items:
        scored = []
        for place, (i, c) in enumerate(found):
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, place))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, term int, row int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, word int")
    return sorted([tuple(r) for r in impact.search(d, q, **more).collect()], key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK", 40)
    monkeypatch.setattr(impact, "ITEMS", 3)
    rng = np.random.default_rng(1)
    said = lambda n: " ".join(f"W{min(int(x), 60)}" for x in rng.zipf(1.4, n))
    docs = [(i, said(rng.integers(1, 60))) for i in range(200)] + [(1000 + i, "W1 w2, w3") for i in range(60)]
    items = [(i, said(rng.integers(1, 30))) for i in range(8)]
    want = brute(docs, items, 7)
    assert run(spark, docs, items, k=7) == want and len(want) > 40


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "..!"), (4, "É été ÀB naïve"), (5, "abc ABC\x00abc"), (5, "abc ABC\x00abc"), (None, "abc x"), (None, "abc x"), (7, "x " * 30000 + "abc"), (8, "x_y`z{0}9")]
    items = [(1, "abc Abc, x!"), (1, "abc Abc, x!"), (2, None), (3, "?"), (4, "été À b ÀB"), (5, "none such"), (6, "y z 0 9"), (7, "x " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)
    assert run(spark, [], items) == [] == run(spark, docs, [])


@pytest.mark.parametrize("k", [1, 5, 400])
def test_best_of_slices(k):
    rng = np.random.default_rng(2)
    values = [rng.integers(0, top, 300) for top in (5, 1 << 35, 2)]
    term = np.repeat([7, 8, 9], 300)
    index = impact.Slices(term, np.tile(np.arange(300), 3), np.concatenate(values), 300)
    total = values[0] * 5 + values[1] + values[2] * 3
    slices = index.scores([(7, 5), (8, 1), (9, 3), (10, 2)])
    places, scores = impact.best(slices, k)
    want = sorted(((-s, i) for i, s in enumerate(total.tolist()) if s > 0))[:k]
    assert sorted(zip((-scores).tolist(), places.tolist())) == want


def test_query_against_sql(spark):
    assert same(spark, registry.op13_ranked_search, registry.OP13_SQL, "/root/testdata/sf0.01") > 500
