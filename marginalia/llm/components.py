"""Connected components of a graph held as a DataFrame of links.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond"): each is a minimum per node, combined before the shuffle, and a join
on the node. Minima and rounds are written to the shared folder, so both sides of a join are
scans with a shuffle each, and AQE can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.staging import settle, stage


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(now: DataFrame) -> DataFrame:
    both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
    low = stage(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "links-low")
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    large = stage(large, "links-large")
    low = stage(large.groupBy("u").agg(F.min("v").alias("low")), "links-low")
    small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.union(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every end of ``links`` (u, v: any ordered type).

    Loops and repeated links do no harm; no links give no rows.
    """
    now = stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while True:
        now = settle(links.sparkSession, "links-round", lambda now=now: _round(now))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
