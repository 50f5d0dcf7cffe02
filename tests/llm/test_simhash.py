import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from marginalia.llm import registry, simhash
from marginalia.llm.components import connected_components


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_code_is_perfect():
    near = simhash.nearest_codeword()
    assert (np.bincount(near) == 2048).all()


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É é Ü a b", "a\x0bb\x0cc\xa0d e", "x " * 70000, "w1 w2 w3 w4 w5"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_every_link_is_met_once(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for n in (1, 2, 3, 4):
            for _ in range(12):
                g = f
                for b in rng.sample(range(64), n):
                    g ^= 1 << b
                fps.add(g)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    want = {tuple(sorted((signed[i], signed[j]))) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert len(got) == len(want) and {(r.u, r.v) for r in got} == want


def test_components(spark):
    rng = random.Random(6)
    for n, m in ((40, 30), (60, 59), (5, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(200 + i, 201 + i) for i in range(30)] * (m > 0)
        root = {x: x for e in links for x in e}
        for _ in root:
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
        assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}


def check(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    low = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    want = sorted([(i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, comp)], key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, registry.op8_simhash(spark, d).collect())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b  C"), (None, "q"), (5, "long text " * 3000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(2)
    check(rows, simhash.label(docs).collect())
    assert simhash.label(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (3, "a b c", 3), (3, "a b c", 4), (None, "a b  C", 5), (None, "q", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, fp int").write.parquet(str(tmp_path / "d"))
    got = simhash.keep(spark.read.parquet(str(tmp_path / "d")))
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == [(1, None), (3, "a b c"), (None, "q")]
