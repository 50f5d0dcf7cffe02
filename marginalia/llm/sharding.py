"""Sharding of documents by extendible hashing.

A shard is a prefix of the bits of the key's hash. The directory begins with one bucket, the
empty prefix; a bucket over the byte limit splits on its next bit, others stay. The outcome
is that each key lies in the shortest prefix whose rows fit the limit, which is computed
for many levels at once: bytes are summed by cells of LEVELS more bits, the cells rolled up to
every shorter prefix, and only cells still over the limit go to the next round. Directory and
cells are DataFrames, so they may grow with the data.

Defined results: null text has 0 bytes; a null key hashes as empty text. A row over the limit
cannot be split, so it is a shard of its own, as are pages of rows that share all hash bits
(repeated keys) and exceed the limit together; such shards have "/page" after their bits. An
empty table has no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.staging import stage

from .common import fresh, text_or_empty

BITS, LEVELS = 60, 8
#: Rows numbered together when repeated keys are dealt to pages.
PAGE_ROWS = 100_000


def bits_of(key: F.Column) -> F.Column:
    """The first 60 bits of the key's md5, as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")


def prefix(bits: str, n: int | F.Column) -> F.Column:
    return F.substring(F.col(bits), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, bytes, shard, depth (bits in use), shard_bytes, shard_rows."""
    return _assign(docs, limit, key, text, F.monotonically_increasing_id()).drop("row").withColumnRenamed("key", key)


def _assign(docs: DataFrame, limit: int, key: str, text: str, row: F.Column) -> DataFrame:
    """See assign; the key is named ``key``, and ``row`` tells rows of one key apart."""
    size = F.octet_length(text_or_empty(text)).cast("long")
    rows = stage(docs.select(F.col(key).alias("key"), size.alias("bytes"), bits_of(F.col(key)).alias("bits"), row.alias("row")), "shard-rows")
    done, left, depth = [], rows.where(F.col("bytes") <= limit), 0
    while True:
        total = left.agg(F.sum("bytes")).first()[0]
        if total is None:
            break
        fill = int(total // limit).bit_length() if depth == 0 else 0  # levels that a directory of this size needs anyway
        to = min(BITS, depth + fill + LEVELS)
        cells = left.groupBy(prefix("bits", to).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        directory = stage(_directory(cells, depth, to, limit), "shard-directory")
        found = left.join(directory, prefix("bits", to) == F.col("cell"), "left")
        done.append(found.where("shard IS NOT NULL").select("row", "key", "bytes", "shard", "depth", "shard_bytes", "shard_rows"))
        if directory.where("shard IS NULL").isEmpty():
            break
        left = stage(found.where("shard IS NULL").select(*rows.columns), "shard-left")
        if to == BITS:
            done.append(_pages(left, limit))
            break
        depth = to
    solo = rows.where(F.col("bytes") > limit)
    done.append(solo.select("row", "key", "bytes", F.concat_ws("/", "bits", F.col("row").cast("string")).alias("shard"), F.lit(BITS).alias("depth"), F.col("bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows")))
    return reduce(DataFrame.unionByName, done)


def _directory(cells: DataFrame, above: int, to: int, limit: int) -> DataFrame:
    """The shard of each cell of ``to`` bits; null where the cell itself is over the limit.

    ``above`` is the level at which all prefixes are known to be over the limit, or 0.
    """
    spread = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(to))).alias("depth"))
    spread = spread.withColumn("shard", prefix("cell", F.col("depth")))
    fit = spread.groupBy("shard", "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")).where(F.col("shard_bytes") <= limit)
    best = spread.select("cell", "shard", "depth").join(fit, ["shard", "depth"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("best"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "best.shard", "best.depth", "best.shard_bytes", "best.shard_rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows that share all bits. They are numbered in slices of bounded size."""
    from pyspark.sql import Window

    about = rows.groupBy("bits").agg(F.max("bytes").alias("most"), F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / PAGE_ROWS)
    cut = rows.join(about, "bits").withColumn("slice", F.pmod(F.xxhash64("row"), slices))
    place = F.row_number().over(Window.partitionBy("bits", "slice").orderBy("row")) - 1
    page = F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most"))))
    paged = stage(cut.select("row", "key", "bytes", F.concat_ws("/", "bits", "slice", page.cast("string")).alias("shard")), "shard-pages")
    sums = paged.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return paged.join(sums, "shard").select("row", "key", "bytes", "shard", F.lit(BITS).alias("depth"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with a folder ``shard=...`` for each shard: every row once, whatever its key.

    Where ``docs`` has a column shard itself, the folders are named by the first free of shard1, shard2, ...
    """
    row = fresh(docs, "row")[0]
    taken = {c.lower() for c in docs.columns}
    folder = next(n for n in ("shard", *(f"shard{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "shard-numbered")
    shards = _assign(numbered, limit, key, text, F.col(row))
    shards = shards.select(F.col("row").alias(row), F.concat(F.lit("p"), F.regexp_replace("shard", "/", "_")).alias(folder))
    numbered.join(shards, row).drop(row).repartition(folder).write.partitionBy(folder).parquet(path)
