"""Searches of several steps: a question cut into parts whose results are fused, and hits that lead to further hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators.search import search_all

from .staging import stage

#: The rank's offset in reciprocal-rank fusion, a fixed value, and the digits to which fused scores are compared.
OFFSET, DIGITS = 60, 9
#: Where a question is cut into parts.
JOINTS = r"(?i)[?;]+|,?\s+(?:and|as well as|or)\s+"


def parts_of(question: Column | str) -> Column:
    """The question itself, then the parts that it is joined of, if there are several; each once, blank ones left out."""
    whole = tx.strip(question)
    cut = F.filter(F.transform(F.split(whole, JOINTS, -1), tx.strip), lambda p: p != "")
    return F.when(whole != "", F.array_distinct(F.concat(F.array(whole), F.when(F.size(cut) > 1, cut).otherwise(F.array().cast("array<string>")))))


def decompose(questions: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, part, query) of each question; part 0 is the question. Null and blank questions have no rows."""
    return questions.select(F.col(qid).alias("qid"), F.posexplode(parts_of(query)).alias("part", "query"))


def fuse(found: DataFrame, k: int, item: str = "chunk_id", qid: str = "qid", offset: int = OFFSET) -> DataFrame:
    """(qid, item, score, rank): the ``k`` items of each question with the highest sum of 1 / (offset + rank) over its parts.

    ``found`` has a row (qid, item, rank) per part and hit. Ties go to the smaller item. Sums combine before the shuffle, and are
    rounded, so that their order does not matter.
    """
    score = F.round(F.sum(1 / (F.lit(offset) + F.col("rank"))), DIGITS).alias("score")
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), item))
    return found.groupBy(qid, item).agg(score).withColumn("rank", rank).where(F.col("rank") <= k)


def search_parts(rows: DataFrame, questions: DataFrame, k: int, embedder: Callable[[DataFrame], DataFrame], item: str = "chunk_id", deep: int | None = None) -> DataFrame:
    """(qid, item, score, rank): each question's parts are embedded, searched for in one scan (``deep`` hits each) and fused."""
    parts = decompose(questions).withColumn("asked", F.struct("qid", "part"))
    vectors = stage(embedder(parts.withColumnRenamed("query", "text")).select("asked", F.col("vector").alias("query_vector")), "explore-parts")
    found = search_all(rows, vectors, deep or k, item, qid="asked")
    return fuse(found.select("asked.qid", item, "rank"), k, item)


def hops(start: DataFrame, follow: Callable[[DataFrame], DataFrame], most: int, qid: str = "qid", item: str = "item") -> DataFrame:
    """(qid, item, hop): what is reached from ``start`` (qid, item) in at most ``most`` steps, with the least number of steps.

    ``follow`` gives (item, next) for the distinct items of a frontier: links of notes, or the nearest rows of hits. In each round the
    frontier's items are followed once, whatever number of questions have come to them; what a question has seen before is anti-joined.
    It ends when a round brings nothing new. Rounds are written tables, so nothing passes through the driver.
    """
    now = stage(start.select(F.col(qid).alias("qid"), F.col(item).alias("item")).where("item IS NOT NULL").distinct(), "hops-start")
    seen = now.withColumn("hop", F.lit(0))
    for hop in range(1, most + 1):
        led = stage(follow(now.select("item").distinct()).select("item", "next").where("next IS NOT NULL").distinct(), "hops-led")
        reached = now.join(led, "item").select("qid", F.col("next").alias("item")).distinct()
        now = stage(reached.join(seen.select("qid", "item"), ["qid", "item"], "left_anti"), "hops-now")
        if now.isEmpty():
            break
        seen = seen.union(now.withColumn("hop", F.lit(hop)))
    return seen.select(F.col("qid").alias(qid), F.col("item").alias(item), "hop")


def nearest(rows: DataFrame, k: int, item: str = "chunk_id", vector: str = "vector") -> Callable[[DataFrame], DataFrame]:
    """A ``follow`` for ``hops``: the ``k`` rows nearest to each item's own vector."""

    def follow(items: DataFrame) -> DataFrame:
        asked = rows.join(items.select(F.col("item").alias(item)), item).select(F.col(item).alias("from"), F.col(vector).alias("query_vector"))
        return search_all(rows, stage(asked, "hops-asked"), k, item, vector, qid="from").select(F.col("from").alias("item"), F.col(item).alias("next"))

    return follow


def linked(links: DataFrame, source: str = "path", target: str = "found") -> Callable[[DataFrame], DataFrame]:
    """A ``follow`` for ``hops``: the ends of links, such as ``notes.resolve`` gives."""
    return lambda items: items.join(links.select(F.col(source).alias("item"), F.col(target).alias("next")), "item")
