"""Retrieval metrics from (qid, rank, id) results and (qid, id) relevance.

Per-query metrics begin from the query table, so queries without hits or without relevance count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(queries: DataFrame, results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), qid: str = "qid", item: str = "id") -> DataFrame:
    """qid, retrieved, relevant, recall@k of all ks, mrr over all results. Repeated hits count repeatedly."""
    marked = results.join(relevant.select(qid, item).distinct().withColumn("rel", F.lit(1)), [qid, item], "left")
    hits = marked.groupBy(qid).agg(
        F.count("*").alias("retrieved"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        *(F.count_if((F.col("rel") == 1) & (F.col("rank") <= k)).alias(f"hits{k}") for k in ks),
    )
    wanted = relevant.select(qid, item).distinct().groupBy(qid).agg(F.count("*").alias("relevant"))
    joined = queries.select(qid).join(hits, qid, "left").join(wanted, qid, "left")
    recall = [F.coalesce(F.col(f"hits{k}") / F.col("relevant"), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    zero = F.lit(0).cast("long")
    return joined.select(qid, F.coalesce("retrieved", zero).alias("retrieved"), F.coalesce("relevant", zero).alias("relevant"), *recall, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"))


def summary(metrics: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """num_queries and the means; without queries the means are null."""
    return metrics.agg(
        F.count("*").alias("num_queries"), F.avg("retrieved").alias("avg_retrieved"), *(F.avg(f"recall_at_{k}").alias(f"recall_at_{k}") for k in ks), F.avg("mrr").alias("mrr")
    )


def details(queries: DataFrame, results: DataFrame, top: int = 10, qid: str = "qid", item: str = "chunk_id", relevant: str = "relevant_chunk_ids") -> DataFrame:
    """qid, query, relevant_count and retrieved_top10: the first ``top`` ids of each query in rank order, none where nothing was found."""
    best = results.where(F.col("rank") <= top).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("id")))).alias("best"))
    joined = queries.select(qid, "query", F.size(relevant).cast("long").alias("relevant_count")).join(best, qid, "left")
    found = F.transform("best", lambda x: x["id"])
    return joined.select(qid, "query", "relevant_count", F.coalesce(found, F.slice(F.array(F.lit(None).cast(results.schema[item].dataType)), 1, 0)).alias("retrieved_top10"))


def by_file(queries: DataFrame, results: DataFrame, expected: DataFrame, k: int = 5, qid: str = "qid") -> DataFrame:
    """qid, hit (0 or 1), mrr and dupes of the file names within the first ``k``; missing names repeat too."""
    top = results.where(F.col("rank") <= k).join(expected.select(qid, "file_name").distinct().withColumn("rel", F.lit(1)), [qid, "file_name"], "left")
    got = top.groupBy(qid).agg(
        F.max(F.coalesce("rel", F.lit(0))).alias("hit"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        (F.count("*") - F.count_distinct(F.coalesce(F.col("file_name"), F.lit("\x00")))).alias("dupes"),
    )
    zero = F.lit(0)
    return queries.select(qid).join(got, qid, "left").select(qid, F.coalesce("hit", zero).alias("hit"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), F.coalesce("dupes", zero.cast("long")).alias("dupes"))


def by_file_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("num_queries"), F.avg("hit").alias("hit_rate"), F.avg("mrr").alias("mrr"), F.avg("dupes").alias("dupes"))
