import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunk, context, embed, evaluate, search, select
from marginalia.plans import config, rag


def brute_chunks(text, size, overlap):
    step, out = max(1, size - overlap), []
    if text.strip():
        for i in range(0, len(text), step):
            if part := text[i : i + size].strip():
                out.append((len(out), i, min(len(text), i + size), part))
    return out


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 0), (4, 9), (1200, 150)])
def test_fixed_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "   ", "x" * 1050, "y" * 1200] + ["".join(rng.choice("ab é 　\n") for _ in range(rng.randrange(60))) for _ in range(100)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = chunk.fixed(docs, size, overlap).collect()
    want = [(str(i), *c) for i, t in enumerate(texts) for c in brute_chunks(t, size, overlap)]
    assert sorted((r.doc_id, r.chunk_index, r.start_char, r.end_char, r.text) for r in got) == sorted(want)
    assert all(r.chunk_id == f"{r.doc_id}:fixed:{r.chunk_index}:{r.start_char}-{r.end_char}" for r in got)


def test_null_text_has_no_chunks(spark):
    assert chunk.fixed(spark.createDataFrame([("a", None)], "doc_id string, text string")).count() == 0


def test_digest_vector_repeats(spark):
    v = spark.createDataFrame([("t",)], "text string").select(embed.digest_vector("text", 64).alias("v")).first().v
    assert v[:32] == v[32:] and all(-1 <= x <= 1 for x in v)


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="dimensions"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(search.cosine(F.col("a"), F.col("b"))).collect()


def test_filter_none_meets_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "n int, k string")
    assert [r.n for r in rows.where(search.metadata_filter({"k": None})).collect()] == [1]


@pytest.mark.parametrize("shared", [1 << 20, 128])
def test_search_all_in_blocks(spark, monkeypatch, shared):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "SHARED", shared)
    monkeypatch.setattr(search, "SLICE", 16)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:10])] + [(99, None)], "qid long, query_vector array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    s = np.round(u[:10] @ u.T, 6)
    want = {(q, r + 1, i) for q in range(10) for r, i in enumerate(sorted(range(60), key=lambda i: (-s[q, i], i))[:7])}
    assert {(r.qid, r["rank"], r.id) for r in search.search_all(rows, queries, 7, "id").collect()} == want
    assert search.search(rows, [1.0, 0.0, 0.0, 0.0], 100, ties=("id",)).count() == 60
    named = search.search_all(rows.withColumn("id", F.format_string("n%03d", "id")), queries, 7, "id")
    assert {(r.qid, r["rank"], int(r.id[1:])) for r in named.collect()} == want
    assert search.search_all(rows, queries.limit(0), 7, "id").count() == search.search_all(rows, queries, 0, "id").count() == 0


def brute_mmr(q, vs, k, lam):
    cos = lambda a, b: float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))
    picked = []
    while len(picked) < min(k, len(vs)):
        left = [i for i in range(len(vs)) if i not in picked]
        picked.append(max(left, key=lambda i: (round(lam * cos(q, vs[i]) - (1 - lam) * max([cos(vs[i], vs[j]) for j in picked], default=0.0), 12), -i)))
    return picked


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.65, 1.0])
def test_mmr(spark, lam):
    rng = np.random.default_rng(int(lam * 10))
    rows, want = [], {}
    for q in range(4):
        n = int(rng.integers(1, 15))
        vs, qv = rng.normal(size=(n, 6)), rng.normal(size=6)
        rows += [(q, i, v.tolist(), qv.tolist()) for i, v in enumerate(vs)]
        want[q] = brute_mmr(qv, vs, 8, lam)
    df = spark.createDataFrame(rows, "qid int, node_id int, vector array<double>, query_vector array<double>").repartition(3)
    got = {}
    for r in select.mmr(df, 8, lam).orderBy("mmr_rank").collect():
        got.setdefault(r.qid, []).append(r.node_id)
    assert got == want
    assert select.mmr(df, 0).count() == 0


@pytest.mark.parametrize("reply, keep, want", [
    ('ok {"ranked":[2,"0",2,9]}', 2, [2, 0]), ("no json", 2, [0, 1]), (None, 2, [0, 1]), ('{"ranked": []}', 5, [0, 1, 2]), ('{"ranked": 3}', 1, [0]),
    ('{"ranked": [true, -1, "x", 1.5, 1]}', 3, [1]), ('{"a": 1} {"ranked": [1]}', 1, [0]), ('{"ranked": [1]}', 0, []),
])
def test_rerank_order(reply, keep, want):
    assert select.rerank_order(reply, 3, keep) == want


def test_llm_rerank_and_its_failure(spark):
    rows = spark.createDataFrame([(q, i + 1, "q", f"f{i}", None, f"text {i}") for q in (1, 2) for i in range(4)], "qid int, ord int, query string, file_name string, section_heading string, text string")

    def reverse(prompt):
        items = json.loads(prompt[prompt.index("Chunks: ") + 8 :])
        return json.dumps({"ranked": [x["i"] for x in reversed(items)]})

    def broken(prompt):
        raise RuntimeError

    order = lambda df: [r.file_name for r in df.where("qid = 1").orderBy("rerank_rank").collect()]
    assert order(select.llm_rerank(rows, reverse, 3)) == ["f3", "f2", "f1"]
    assert order(select.llm_rerank(rows, broken, 2, retries=1)) == ["f0", "f1"]


def test_dedupe_keeps_rows_without_source(spark):
    rows = spark.createDataFrame([(1, "a", "s", 0.5), (1, "b", "s", 0.7), (1, "c", None, 0.1), (1, "d", "", None), (1, "e", None, 0.1)], "qid int, node_id string, source_path string, score double")
    assert sorted(r.node_id for r in select.dedupe_by_source(rows).collect()) == ["b", "c", "d", "e"]
    assert [r.node_id for r in select.ranked(rows).orderBy("ord").collect()] == ["b", "a", "c", "e", "d"]


def brute_pack(cands, budget, most, min_score, dedupe, scores):
    est = lambda t: max(1, len(t) // 4)
    used, out, seen = 2, [], set()
    for n, s, r, t in sorted(cands, key=lambda c: (-(c[2] if c[2] is not None else c[1]), c[0])):
        s = r if r is not None else s
        if min_score is not None and s < min_score:
            continue
        sig = " ".join(t.lower().split())[:500]
        if dedupe:
            if sig in seen:
                continue
            seen.add(sig)
        label = f"[{len(out) + 1}]" + (f" score={s:.4f}" if scores else "") + "\n"
        cost = est(label) + est(t) + 1
        if used + cost > budget:
            break
        used += cost
        out.append(n)
        if len(out) >= most:
            break
    return out


@pytest.mark.parametrize("budget, most, min_score, dedupe, scores", [(60, 5, None, True, False), (40, 0, 0.3, True, True), (200, 12, None, False, True), (5, 3, 0.9, True, False)])
def test_pack(spark, budget, most, min_score, dedupe, scores):
    rng = random.Random(budget)
    rows = [(q, f"{i:03}", round(rng.random(), 2), rng.choice([None, None, round(rng.random(), 2)]), rng.choice(["a b", "A  b", "x" * 80, "é" * 30, "longer text " * 4])) for q in range(25) for i in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, score double, rerank_score double, text string").repartition(3)
    got = {}
    for r in context.pack(df, budget, most, min_score, dedupe, scores).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    want = {q: p for q in range(25) if (p := brute_pack([r[1:] for r in rows if r[0] == q], budget, most, min_score, dedupe, scores))}
    assert got == want


def test_pack_of_equal_chunks(spark):
    df = spark.createDataFrame([(1, str(i), 1.0 - i / 10, f"{i}" + "x" * 1199) for i in range(10)], "qid int, chunk_id string, score double, text string")
    used = lambda budget: [r.used for r in context.pack(df, budget).orderBy("rank").collect()]
    assert (len(used(1800)), used(1800)[-1]) == (5, 1512) and (len(used(1500)), used(1500)[-1]) == (4, 1210)


def test_answers(spark):
    docs = spark.createDataFrame([("d", "Chunking strategy affects recall. Evaluation metrics like MRR quantify retrieval quality.\n" * 25, "memory://demo")], "doc_id string, text string, uri string")
    questions = spark.createDataFrame([(1, "How do you quantify retrieval quality?"), (2, "zzz")], "qid int, query string")
    index = rag.index(docs, keep=("uri",))
    got = {r.qid: r for r in rag.rag_answer(index, questions, 8, 1500).collect()}
    assert "quality" in got[1].answer and not got[1].abstained and got[2].abstained
    none = rag.rag_answer(index.limit(0), questions, 8, 1500).collect()
    assert len(none) == 2 and all(r.abstained for r in none)
    rendered = context.render(context.pack(rag.retrieve(index, questions, 8), 1500)).first().rendered_context
    assert rendered.startswith("You are given CONTEXT") and "[1]\nSource:  memory://demo\n" in rendered and rendered.endswith("\n")
    asked = spark.createDataFrame([("c", "q")], "c string, q string").select(context.prompt("c", "q").alias("a"), context.prompt("c", "q", context.NOTES_PROMPT).alias("b")).first()
    assert asked.a.startswith("c\n") and asked.a.endswith("Question: q\n") and "Question: q" in asked.b


def test_metrics(spark):
    rng = random.Random(3)
    results, relevant = {}, {}
    for q in range(60):
        results[q] = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))]
        relevant[q] = set(rng.sample("abcdefghij", rng.randrange(0, 4)))
    queries = spark.createDataFrame([(q,) for q in results], "qid int")
    rows = spark.createDataFrame([(q, n, i, i if i != "h" else None) for q, r in results.items() for n, i in enumerate(r, 1)], "qid int, rank int, id string, file_name string")
    rel = spark.createDataFrame([(q, i, i) for q, s in relevant.items() for i in s], "qid int, id string, file_name string")
    got = {r.qid: r for r in evaluate.per_query(queries, rows, rel).collect()}
    for q, found in results.items():
        r, want = got[q], relevant[q]
        first = next((1 / n for n, i in enumerate(found, 1) if i in want), 0.0)
        assert (r.retrieved, r.relevant) == (len(found), len(want)) and math.isclose(r.mrr, first)
        for k in (5, 10):
            assert math.isclose(r[f"recall_at_{k}"], sum(i in want for i in found[:k]) / len(want) if want else 0.0)
    (s,) = evaluate.summary(evaluate.per_query(queries, rows, rel)).collect()
    assert s.num_queries == 60 and math.isclose(s.mrr, sum(r.mrr for r in got.values()) / 60)
    assert evaluate.summary(evaluate.per_query(queries.limit(0), rows, rel)).first().num_queries == 0
    by_file = {r.qid: r for r in evaluate.by_file(queries, rows, rel).collect()}
    for q, found in results.items():
        names = [i if i != "h" else None for i in found[:5]]
        hits = [n for n, i in enumerate(names, 1) if i is not None and i in relevant[q]]
        assert (by_file[q].hit, by_file[q].dupes) == (int(bool(hits)), len(names) - len(set(names)))
        assert math.isclose(by_file[q].mrr, 1 / hits[0] if hits else 0.0)
    assert evaluate.by_file_summary(evaluate.by_file(queries, rows, rel)).first().num_queries == 60


def test_profiles(tmp_path):
    assert config.load_profile("math").retrieve_k == 50
    (tmp_path / "p.json").write_text('{"retrieve_k": 7, "unknown": 1}')
    p = config.load_profile("p", str(tmp_path))
    assert p == config.RetrievalConfig(retrieve_k=7)
    assert config.from_flags(p, mmr=True, no_dedupe=True, context_k=2) == config.RetrievalConfig(7, 2, dedupe=False, mmr=True)
    assert config.from_flags(config.PROFILES["math"]).rerank


def test_profile_pipeline_with_replies(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10], f"s{i % 4}", i % 2 == 0, "moc" if i == 4 else "note") for i in range(10)], "node_id int, vector array<double>, source_path string, is_ai boolean, classification string")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query_vector array<double>")
    raw, final = rag.by_profile(rows, queries, config.RetrievalConfig(retrieve_k=8, context_k=2, ai_only=True))
    assert sorted(r.node_id for r in raw.collect()) == [0, 2, 6, 8]
    assert [r.node_id for r in final.orderBy("ord").collect()] == [0, 2]
    replies = spark.createDataFrame([(1, '{"ranked": [2, 1]}')], "qid int, reply string")
    _, final = rag.by_profile(rows, queries, config.RetrievalConfig(retrieve_k=8, context_k=2, dedupe=False, rerank=True, include_moc=True), replies)
    assert [r.node_id for r in final.orderBy("ord").collect()] == [2, 1]
