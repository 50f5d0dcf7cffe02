import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import cells, search


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist() if v is not None else None, i % 3) for i, v in enumerate(x)], "id long, vector array<double>, kind int")


def clustered(n, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [centres[i % 12] + spread * rng.normal(size=16) for i in range(n)]


def asked(x):
    return [(f"q{i}", v.tolist()) for i, v in enumerate(x)]


def got(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 0.5, 4.0])
def test_equal_to_a_search_over_all(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(cells, "SLICE", 25)
    monkeypatch.setattr(cells, "ASKED", 4)
    x = [*clustered(300, spread), np.zeros(16), np.zeros(16), None, *clustered(20, 0, 1)]
    rows = frame(spark, x)
    index = cells.build(rows, str(tmp_path / "i"), "id", cells=15)
    again = cells.CellIndex(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame(asked([*clustered(10, 0.3, 1), np.zeros(16), -x[0], x[5]]), "qid string, query_vector array<double>")
    for k in (1, 7, 400):
        assert got(index.search_all(queries, k)) == got(search.search_all(rows, queries, k, "id"))
    for q in (x[3], -x[3], np.zeros(16)):
        for filters in (None, {"kind": 1}):
            want = search.search(rows, q.tolist(), 9, filters, ties=("id",)).collect()
            assert [(r.id, r.score) for r in again.search(q.tolist(), 9, filters).orderBy(F.desc("score"), "id").collect()] == [(r.id, r.score) for r in want]
    with pytest.raises(FileExistsError):
        cells.build(rows, str(tmp_path / "i"), "id", cells=3)


def test_few_cells_are_read(spark, tmp_path, capsys):
    rows = frame(spark, clustered(1200, 0.02))
    index = cells.build(rows, str(tmp_path / "i"), "id", cells=24)
    found = index.search(clustered(1, 0.02)[0].tolist(), 10)
    found.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*_cell#", capsys.readouterr().out)
    needed = index.rows().where(F.col("_cell").isin([int(c) for c in _cells_read(index, clustered(1, 0.02)[0], 10)])).count()
    assert needed < 0.35 * 1200


def _cells_read(index, query, k):
    order, bounds = (x[0] for x in index.bounds(np.array([query])))
    first = search.search(index.rows(order[: cells.PROBED]), query.tolist(), k, None, "vector", ("id",)).collect()
    return order[bounds >= first[-1].score - cells.SLACK]


def test_no_rows(spark, tmp_path):
    index = cells.build(frame(spark, [None, None]), str(tmp_path / "i"), "id")
    queries = spark.createDataFrame(asked([np.ones(3)]), "qid string, query_vector array<double>")
    assert index.search_all(queries, 3).count() == 0 == index.search([1.0, 2.0, 3.0], 3).count()
    one = cells.build(frame(spark, [np.zeros(3)]), str(tmp_path / "j"), "id")
    assert got(one.search_all(queries, 3)) == [("q0", 1, 0, 0.0)]
