import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import jaccard, registry


def brute(docs, shingle=3, least=(9, 10)):
    """A row per document; links of places, then the smallest id of each component."""
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append(set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)} - {()})
    held, parent = defaultdict(list), list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in held[g]).items():
            if least[1] * both >= least[0] * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            held[g].append(i)
    low = defaultdict(list)
    for i, (name, _) in enumerate(docs):
        low[find(i)].append(name)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((name, len(sets[i]), smallest[find(i)]) for i, (name, _) in enumerate(docs)), key=str)


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, node int").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/docs-{random.getrandbits(60)}")
    return sorted([tuple(r) for r in jaccard.label(spark.read.parquet(path), **more).collect()], key=str)


def near_copies(rng, groups, copies, words, changed):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(copies):
            one = list(base)
            for _ in range(rng.randrange(changed + 1)):
                one[rng.randrange(words)] = f"x{rng.randrange(30)}"
            out.append(" ".join(one))
    return out


@pytest.mark.parametrize("least", [(9, 10), (4, 5)])
def test_against_brute_force(spark, monkeypatch, least):
    """Large classes are cut into rings, blocks and several rounds of columns."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    rng = random.Random(1)
    texts = near_copies(rng, 3, 50, 120, 7) + near_copies(rng, 30, 3, 60, 2) + near_copies(rng, 40, 1, 30, 0)
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    want = brute(docs, least=least)
    assert run(spark, docs, least=least) == want and 20 < len({c for _, _, c in want}) < len(want) - 50


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "a b c a b c"), (None, "a b"), (None, "q r s t"), (None, "Q r s t"), (9, long), (8, long + " end"), (10, long[: len(long) // 2]), (10, "a b")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_bound_is_met_exactly(spark):
    base = [f"b{i}" for i in range(21)]  # 19 shingles; 18 of 20 in either are met at one more word changed
    docs = [(1, " ".join(base)), (2, " ".join([*base[:-1], "z"])), (3, " ".join(base[:-1])), (4, " ".join(base[:-2])), (5, " ".join(base[:-3]))]
    assert run(spark, docs) == brute(docs)


def test_tiles_find_what_pairs_find(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, size=rng.integers(20, 50), replace=False)) if i % 3 else np.unique(np.r_[np.arange(40), rng.integers(40, 60, 2)]) for i in range(40)]
    tile = lambda some: (np.array(some), np.array([len(sets[i]) for i in some]), np.repeat(np.arange(len(some)), [len(sets[i]) for i in some]), np.concatenate([sets[i] for i in some]))

    def joined(found):
        parent = {i: i for i in range(40)}
        for u, v in found:
            a, b = sorted((parent[u], parent[v]))
            parent = {k: a if p == b else p for k, p in parent.items()}
        return parent

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both)

    pairs = [(i, j) for i in range(40) for j in range(i) if linked(i, j)]
    assert joined(zip(*(x.tolist() for x in jaccard.tile_links(tile(range(40)), None, (9, 10))))) == joined(pairs) and len(pairs) > 20
    a, b = list(range(15)), list(range(15, 40))
    across = [(i, j) for i, j in pairs if (i in a) != (j in a)]
    assert joined(zip(*(x.tolist() for x in jaccard.tile_links(tile(a), tile(b), (9, 10))))) == joined(across)


@pytest.mark.parametrize("size", [200, 800])
def test_unlike_groups_cost_no_products(size):
    """Texts with a similarity of about 0.6 are told apart by their sizes, before any columns are multiplied."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for n in range(size):
        one = list(base)
        for i in rng.sample(range(200), 5):
            one[i] = f"x{n}-{i}"
        texts.append(jaccard.shingle_set(" ".join(one), 5))
    column, count = np.unique(np.concatenate(texts), return_counts=True)
    kept = [t[np.isin(t, column[count > 1])] for t in texts]
    tile = np.arange(size), np.array([len(t) for t in texts]), np.repeat(np.arange(size), [len(t) for t in kept]), np.concatenate(kept)
    called = []
    real, jaccard._dense = jaccard._dense, lambda *x: called.append(x[2].sum()) or real(*x)
    try:
        u, _ = jaccard.tile_links(tile, None, (4, 5))
    finally:
        jaccard._dense = real
    assert len(u) == 0 and sum(called) < size


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op12_jaccard_join(spark, d)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs)
