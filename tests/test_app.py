import json

import pytest

from marginalia.plans import app, config
from marginalia.sources import store


def test_build_ask_and_score(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"n{n}.md").write_text(f"note {n}. " + "some words here. " * 100)
    (tmp_path / "in" / "skip.csv").write_text("1")
    folder, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    rows = app.build_index(spark, [str(tmp_path / "in")], folder, "i", cache=cache)
    about = json.loads(spark.read.text(folder + "/manifest").first().value)
    assert about["counts"] == {"documents": 5, "chunks": rows.count()} and about["ingest_report"]["skipped_extension"] == 1 and about["extensions"] == [".md"]
    made = spark.read.parquet(cache).count()
    app.build_index(spark, [str(tmp_path / "in")], folder + "2", "i", cache=cache, max_docs=2)
    assert spark.read.parquet(cache).count() == made and store.IndexTable(spark, folder + "2/chunks").rows().select("doc_id").distinct().count() == 2
    first = rows.orderBy("chunk_id").first()
    questions = spark.createDataFrame([("q", first.text, [first.chunk_id]), ("r", "nothing", [])], "qid string, query string, relevant_chunk_ids array<string>")
    answers, cited = app.ask(rows, questions.select("qid", "query"))
    assert {r.qid for r in answers.collect()} == {"q", "r"} and cited.where("qid = 'q' AND rank = 1").first().chunk_id == first.chunk_id
    summary, details = app.run_eval(rows, questions)
    store.write_eval(summary, details, str(tmp_path / "eval"))
    (part,) = (tmp_path / "eval").glob("*.json")
    told = json.loads(part.read_text())
    assert told["summary"]["num_queries"] == 2 and told["summary"]["recall_at_5"] == 0.5
    assert [(q["qid"], q["relevant_count"], q["retrieved_top10"][0] == first.chunk_id) for q in told["per_query"]][0] == ("q", 1, True)


def test_demo(spark):
    answers, cited = app.demo(spark)
    assert answers.first().qid == "demo" and 0 < cited.count() <= 8


def test_settings(tmp_path):
    text = """
[paths]
vault_dir = "~/v"
index_dir = "$SOME/i"
[chunking]
method = "markdown"
chunk_size = 800
chunk_overlap = 120
[embeddings]
provider = "p"
model = "m"
[llm]
provider = "p"
model = "m"
[retrieval]
top_k = 8
[rerank]
enabled = true
"""
    path = tmp_path / "settings.toml"
    path.write_text(text)
    with pytest.raises(KeyError, match="rerank.keep_k"):
        config.load_settings(str(path))
    path.write_text(text + "keep_k = 4\nmore = 1\n")
    got = config.load_settings(str(path))
    assert got["rerank"] == {"enabled": True, "keep_k": 4} and got["retrieval"]["top_k"] == 8 and got["paths"]["vault_dir"].startswith("/") and "~" not in got["paths"]["vault_dir"]
    with pytest.raises(FileNotFoundError):
        config.load_settings(str(tmp_path / "none.toml"))
    assert config.from_environment({"MODE": "x"})["MODE"] == "x" and config.from_environment({})["MODE"] == "local"
