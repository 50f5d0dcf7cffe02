"""Selection among retrieved rows: order, dedupe by source, diversity, reranking."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import DIGITS, _unit

MMR_CHARS, PREVIEW_CHARS = 2000, 700


def ranked(rows: DataFrame, qid: str = "qid", ties: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """``rows`` with ``ord`` by score within each query, null scores last."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc_nulls_last("score"), *ties)))


def dedupe_by_source(rows: DataFrame, key: str = "source_path", qid: str = "qid", node_id: str = "node_id", ties: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """The best row of each source; rows without one stand for themselves."""
    own = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.concat(F.lit("__missing__::"), F.col(node_id).cast("string")))
    order = Window.partitionBy(qid, own).orderBy(F.desc_nulls_last("score"), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def mmr(rows: DataFrame, k: int, lam: float = 0.7, qid: str = "qid", node_id: str = "node_id", vector: str = "vector", query_vector: str = "query_vector") -> DataFrame:
    """(qid, node_id, mmr_rank): repeatedly the best of lam * cos(query) - (1 - lam) * most cos(selected).

    Candidates per query are few (a retrieved set, its size the search's k). Ties go to the smaller id; values
    are compared to DIGITS digits. Each candidate keeps its most likeness to what is selected, so a turn costs one
    product of the candidates with the last choice.
    """
    q_type, id_type = (rows.schema[c].dataType.simpleString() for c in (qid, node_id))
    schema = f"{qid} {q_type}, {node_id} {id_type}, mmr_rank int"
    if k <= 0:
        return rows.sparkSession.createDataFrame([], schema)

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("id")
        v = _unit(np.stack(found["v"].to_numpy()))
        worth = lam * (v @ _unit(np.stack(found["q"].slice(0, 1).to_numpy()))[0])
        most, left, order = np.zeros(len(v)), np.ones(len(v), bool), []
        for turn in range(min(k, len(v))):
            value = np.where(left, np.round(worth - (1 - lam) * most, DIGITS), -np.inf)
            best = int(np.argmax(value))
            order.append(best)
            left[best] = False
            like = v @ v[best]
            most = like if turn == 0 else np.maximum(most, like)
        columns = [found["qid"].slice(0, 1).take(pa.array([0] * len(order))), found["id"].take(pa.array(order)), pa.array(range(1, len(order) + 1), pa.int32())]
        return pa.table(columns, names=[qid, node_id, "mmr_rank"])

    real = rows.where(F.col(vector).isNotNull() & F.col(query_vector).isNotNull())
    one = real.select(F.col(qid).alias("qid"), F.col(node_id).alias("id"), F.col(query_vector).cast("array<double>").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    return one.groupBy("qid").applyInArrow(run, schema)


def rerank_order(reply: str | None, candidates: int, keep: int) -> list[int]:
    """Places that a model's reply lists, within range, each once; the score order where it lists none.

    The reply may hold other text; ``ranked`` of the widest JSON object counts, digits in texts included.
    """
    text = reply or ""
    lo, hi = text.find("{"), text.rfind("}")
    try:
        listed = json.loads(text[lo : hi + 1])["ranked"] if 0 <= lo < hi else None
        places = [int(x) for x in listed if (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, str) and x.isdecimal())]
    except (ValueError, KeyError, TypeError):
        places = []
    good = list(dict.fromkeys(i for i in places if 0 <= i < candidates))
    return (good or list(range(candidates)))[: max(keep, 0)]


def apply_rerank(rows: DataFrame, replies: DataFrame, keep: int, qid: str = "qid") -> DataFrame:
    """``rows`` (with ord from 1) that the query's ``reply`` keeps, with rerank_rank from 1; unlisted ones go.

    A query without a usable reply keeps its first ``keep``.
    """

    @F.pandas_udf("array<int>")
    def order(reply: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rerank_order(r, int(m), keep) for r, m in zip(reply, n, strict=True)])

    counts = rows.groupBy(qid).agg(F.max("ord").alias("n")).join(replies, qid, "left")
    places = counts.select(qid, F.posexplode(order("reply", "n")).alias("_r", "_i"))
    return rows.join(places.select(qid, (F.col("_i") + 1).alias("ord"), (F.col("_r") + 1).alias("rerank_rank")), [qid, "ord"])


def llm_rerank(rows: DataFrame, ask: Callable[[str], str], keep: int, retries: int = 0, qid: str = "qid", query: str = "query", text: str = "text") -> DataFrame:
    """Rerank with a model behind ``ask`` (prompt to reply), one prompt per query; a failing model keeps the score order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("file_name").alias("file"), F.col("section_heading").alias("section"), F.substring(text, 1, PREVIEW_CHARS).alias("preview"))))
    prompts = rows.groupBy(qid).agg(F.first(query).alias("query"), F.to_json(items).alias("items"))
    kind = rows.schema[qid].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({qid: frame[qid], "reply": [_ask(ask, q, i, retries) for q, i in zip(frame["query"], frame["items"], strict=True)]})

    return apply_rerank(rows, prompts.mapInPandas(run, f"{qid} {kind}, reply string"), keep, qid)


def _ask(ask: Callable[[str], str], query: str, items: str, retries: int) -> str | None:
    listed = [{"i": x.pop("ord") - 1, **x} for x in json.loads(items)]
    prompt = f'Order the chunks by relevance to the query. Return only JSON: {{"ranked": [indices]}}.\nQuery: {query}\nChunks: {json.dumps(listed, ensure_ascii=False)}'
    for _ in range(retries + 1):
        try:
            return ask(prompt)
        except Exception:  # any failure of the outside model keeps the score order
            continue
    return None
