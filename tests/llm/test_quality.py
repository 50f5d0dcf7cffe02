import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.llm import quality, registry


def test_pairwise_identity():
    rng = np.random.default_rng(8)
    model = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    rows = [(rng.choice(quality.FEATURES, n, replace=False), rng.normal(size=n)) for n in (1, 2, 7, 20)]
    got = model.raw(np.concatenate([w for w, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum([0, *(len(w) for w, _ in rows)]))
    for (w, x), g in zip(rows, got):
        pairs = sum(model.factors[w[i]] @ model.factors[w[j]] * x[i] * x[j] for i in range(len(w)) for j in range(i))
        assert np.isclose(g, 0.3 + model.linear[w] @ x + pairs)


def test_features_do_not_depend_on_the_batch():
    texts = [None, "", "One one TWO", "é\n\n!!!", "x " * 5000, "a\tb"]
    sizes = pa.array([1.0, None, 3, 4, 5, None])
    which, value, bounds = quality.features(pa.array(texts), sizes)
    for i, t in enumerate(texts):
        w, v, _ = quality.features(pa.array([t], pa.string()), sizes[i : i + 1])
        assert (w == which[bounds[i] : bounds[i + 1]]).all() and np.allclose(v, value[bounds[i] : bounds[i + 1]])
        assert len(w) >= quality.STATISTICS


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = registry.op9_quality(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == r.quality for r in rows])
    kept = np.mean([r.predicted for r in rows if r.quality])
    print(f"held out {len(rows)}, AUC {auc:.4f}, accuracy {right:.4f}, good kept {kept:.4f}")
    assert auc > 0.97 and right > 0.95 and kept > 0.97


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (2, "", -5, "x"), (2, "", 0, "x"), (None, "some text", None, "x"), (5, "y " * 50000, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (5, 0), (5, 0), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, known)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_ids_and_names_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("q").alias("lang"), F.lit("w").alias("source"), "n_chars")
    a, b = ({r.doc_id: r.score for r in quality.score(x, model).collect()} for x in (docs, other))
    assert all(np.isclose(b[i + 7], s) for i, s in a.items())


def test_a_repeated_id_is_one_sample(spark, monkeypatch):
    got = []
    monkeypatch.setattr(quality, "fit", lambda rows: got.append(sorted((y, w.tolist(), v.tolist()) for y, w, v in rows)))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    rows = [(ids[0], f"copy {i}", i) for i in range(30)] + [(i, f"text of {i}", 9) for i in ids]
    labels = spark.createDataFrame([(i, int(n > 3)) for n, i in enumerate(ids)], "doc_id long, quality int")
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(parts)
        quality.train(docs, labels, sample=8)
    assert [y for y, *_ in got[0]] == [0] * 4 + [1] * 4 and got[0] == got[1]
