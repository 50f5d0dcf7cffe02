"""Embedding: a deterministic embedder for wiring and tests, models behind a function, and a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import _col, cache_key

from .models import with_model

DIM = 128
DIGEST = 32


def digest_vector(text: Column | str, dim: int = DIM) -> Column:
    """The bytes of the text's sha256, over and over up to ``dim``, each spread over -1 to 1. Not semantic."""
    byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    # the text is hashed once: a lambda's variable holds the digest, and its values are repeated
    once = F.transform(F.array(F.sha2(_col(text), 256)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(min(dim, DIGEST) - 1)), lambda i: byte(d, i) / F.lit(127.5) - F.lit(1.0)))
    return F.slice(F.flatten(F.array_repeat(F.get(once, F.lit(0)), -(-dim // DIGEST))), 1, dim)


def dummy(rows: DataFrame, text: str = "text", dim: int = DIM) -> DataFrame:
    return rows.withColumn("vector", digest_vector(text, dim))


def by_model(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", **limits: float) -> DataFrame:
    """Vectors of an external model, a list of texts at a time. ``limits`` bound and repeat its requests, and ``error`` names a column for failures; see ``models.with_model``."""
    return with_model(rows, embed, "array<double>", (text,), "vector", **limits)


def missing(rows: DataFrame, cache: DataFrame, model: str, dim: int | None = None, text: str = "text") -> DataFrame:
    """Distinct (key, text) of ``rows`` that ``cache`` lacks."""
    wanted = rows.select(cache_key(model, text, dim).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return wanted.join(cache.select("key"), "key", "left_anti")


def cached(rows: DataFrame, cache: DataFrame, embedder: Callable[[DataFrame], DataFrame], model: str, dim: int | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``rows`` with vectors, and the new (key, model, vector) to append to the cache.

    Each distinct text is embedded once; where the cache repeats a key, one of its rows counts.
    """
    fresh = embedder(missing(rows, cache, model, dim, text)).select("key", F.lit(model).alias("model"), "vector")
    known = cache.select("key", "vector").groupBy("key").agg(F.first("vector").alias("vector")).unionByName(fresh.select("key", "vector"))
    out = rows.withColumn("_key", cache_key(model, text, dim)).join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return out, fresh
