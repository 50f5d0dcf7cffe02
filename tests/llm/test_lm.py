import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from marginalia.llm import lm, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_paths(word, pieces, logp, by_byte):
    """Every segmentation of ``word`` as a list of piece numbers."""
    if not word:
        return [[]]
    out = []
    for i, p in enumerate(pieces):
        if p and i not in by_byte and word.startswith(p):
            out += [[i, *rest] for rest in brute_paths(word[len(p) :], pieces, logp, by_byte)]
    spelled = [by_byte[b] for b in word[0].encode()]
    return out + [[*spelled, *rest] for rest in brute_paths(word[1:], pieces, logp, by_byte)]


def small_lattice():
    by_byte = list(range(256))
    pieces = [""] * 256 + ["", "a", "b", "ab", "abc", "bc", "é", "▁", "▁a", "cab"]
    rng = np.random.default_rng(12)
    logp = np.log(rng.dirichlet(np.ones(len(pieces))))
    return lm.Lattice(pieces, by_byte), pieces, logp, by_byte


def test_lattice_against_brute_force():
    lattice, pieces, logp, by_byte = small_lattice()
    rng = random.Random(13)
    words = ["", "a", "é", "日"] + ["".join(rng.choice("abcé▁") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    counts = np.array([rng.randrange(5) for _ in words])
    got, uses = lattice.log_likelihood(words, logp), lattice.expected(words, counts, logp)
    want_uses = np.zeros(len(pieces))
    for w, n, g in zip(words, counts, got):
        paths = brute_paths(w, pieces, logp, by_byte)
        mass = [math.exp(sum(logp[i] for i in p)) for p in paths]
        assert math.isclose(g, math.log(sum(mass)), abs_tol=1e-9)
        for p, m in zip(paths, mass):
            for i in p:
                want_uses[i] += n * m / sum(mass)
    assert np.allclose(uses, want_uses)


def brute_forward(word, table, by_byte, logp):
    """Log probability of a word by the plain recursion over its places."""
    total = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        ways = [total[end - 1] + sum(logp[by_byte[b]] for b in word[end - 1].encode())]
        ways += [total[start] + logp[table[word[start:end]]] for start in range(end) if word[start:end] in table]
        top = max(ways)
        total[end] = top + math.log(sum(math.exp(w - top) for w in ways))
    return total[-1]


def test_query_scores_against_brute_force(spark, monkeypatch):
    """The query's own scores: the fitted shares put into a plain recursion, word by word."""
    import sentencepiece

    kept = []
    fitted = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(fitted(*a)) or kept[-1])
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r.score for r in registry.op6_lm_score(spark, d).collect()}
    (logp,) = kept
    assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-6)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    by_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    table = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    known = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        for w in words:
            if w not in known:
                known[w] = brute_forward("▁" + w, table, by_byte, logp)
        want = (math.fsum(known[w] for w in words) + logp[model.eos_id()]) / math.log(10)
        assert math.isclose(got[r.doc_id], want, rel_tol=1e-9, abs_tol=1e-6)


def test_prior_follows_stored_scores():
    assert np.allclose(lm.prior(np.array([0.0, -1, -5])) / lm.prior(np.array([0.0])), [1, lm.RANK_SHIFT / (lm.RANK_SHIFT + 1), lm.RANK_SHIFT / (lm.RANK_SHIFT + 5)])
    assert np.allclose(lm.prior(np.log([0.5, 0.3, 0.2])), [1, 0.6, 0.4])


def test_long_words_do_not_underflow():
    lattice, _, logp, _ = small_lattice()
    assert np.isfinite(lattice.log_likelihood(["abc" * 3000, "x"], logp)).all()


def brute(rows):
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]

    def fold(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 5

    seen = Counter(x for i, t in rows if fold(i) != 1 for x in tokens(t))
    total, kinds = sum(seen.values()), len(seen)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((seen[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in own)
        out.append((i, fold(i) == 1, len(own), sum(seen[x] > 0 for x in own), total, round(base, 6)))
    return sorted(out, key=str)


def plain(rows):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows], key=str)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " a B\x0bb a"), (3, " a B\x0bb a"), (None, "É é x"), (5, "word " * 30000), (6, "z" * 20000), (12, "held a")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(3)
    got = lm.score(docs, PATH).collect()
    assert plain(got) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(docs.limit(0), PATH).count() == 0
    only_held = [(i, t) for i, t in [(2, "a b"), (8, "c")] if zlib.crc32(str(i).encode()) % 5 == 1] or [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a b")]
    assert plain(lm.score(spark.createDataFrame(only_held, "doc_id long, text string"), PATH).collect()) == brute(only_held)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = registry.op6_lm_score(spark, d).collect()
    assert plain(got) == brute(rows)
    held = [r for r in got if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held))
    shuffled = {}
    rng = random.Random(14)
    for i, t in rows:
        letters = list(t)
        rng.shuffle(letters)
        shuffled[i] = "".join(letters)
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(100000 + i, shuffled[i]) for i, _ in rows if zlib.crc32(str(100000 + i).encode()) % 5 == 1], "doc_id long, text string")
    by_id = {r.doc_id: r.score for r in lm.score(docs, PATH).collect()}
    pairs = [(by_id[i], by_id[100000 + i]) for i, _ in rows if 100000 + i in by_id]
    assert np.mean([a > b for a, b in pairs]) > 0.95
