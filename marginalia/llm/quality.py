"""Quality classifier: a factorisation machine over hashed words, text statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is
computed as half of |sum v_i x_i|^2 - sum |v_i x_i|^2, in time linear in the features.

Features of a whole text: log counts of its lower-cased words, hashed to BUCKETS and
scaled to length 1; statistics (shares of character classes, lengths, repetition), each cut
into STEPS levels with a feature per level; and of the metadata n_chars, as levels too. Ids,
languages, sources and labels are not features.

The model is fitted on at most SAMPLE labelled rows, those with the lowest hash of their
id (a documented bound, so what reaches the driver does not grow); of documents that share an
id the one with the lowest hash of its text is learned from. Scoring covers all rows.

Defined results: null text counts as empty, and empty texts get a score from their
statistics; null metadata counts as the text's own length; repeated rows each have a score; a
row whose label is null is not learned from; without any labels all scores are 0.5. Other
columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_column, small_batches, text_blocks

BUCKETS, STEPS, RANK = 1 << 14, 16, 8
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 6000, 6, 32, 0.1, 2e-5
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Character classes by byte of UTF-8: upper, lower, digit, space, line end, other ASCII, beyond ASCII.
CLASSES = 7
STATISTICS = 16
FEATURES = BUCKETS + STATISTICS * STEPS


def byte_classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)
    kind[128:] = 6
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10] = 3, 4
    return kind


KIND = byte_classes()


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row bounds of each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    spelled = words.dictionary.to_pylist()
    bucket = np.array([zlib.crc32(w.encode()) % BUCKETS for w in spelled], np.int64)
    real = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0 if len(spelled) else np.zeros(0, bool)
    row = np.repeat(np.arange(n), np.diff(bounds))
    row, codes = row[real[codes]], codes[real[codes]]
    tokens = np.bincount(row, minlength=n)
    again = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    pairs, counts = np.unique(row * BUCKETS + bucket[codes], return_counts=True)
    at, which = np.divmod(pairs, BUCKETS)
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(at, value * value, n))[at] if len(at) else 1
    distinct = np.bincount(at, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, at, counts)

    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in texts.cast(pa.binary())), np.uint8) if n else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(owner * CLASSES + KIND[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    total, some = np.maximum(size, 1), np.maximum(tokens, 1)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    told = pc.fill_null(n_chars.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    told = np.where(np.isfinite(told), np.maximum(told, 0), length)
    lines = count[:, 4] + 1
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    levels = np.stack(
        [
            *(count[:, k] / total for k in range(CLASSES)),  # 7
            count[:, 0] / letters,
            np.minimum(told, length) / np.maximum(np.maximum(told, length), 1),
            again / some,
            np.log1p(tokens) / 10,
            size / some / 20,
            1 - distinct / some,
            np.maximum(most - 1, 0) / some,
            count[:, 5] / some / 4,
            np.log1p(tokens / lines) / 8,
        ],
        axis=1,
    )
    level = np.clip((np.sqrt(np.clip(levels, 0, 1)) * STEPS).astype(np.int64), 0, STEPS - 1)
    stat = BUCKETS + np.arange(STATISTICS) * STEPS + level
    at = np.concatenate([at, np.repeat(np.arange(n), STATISTICS)])
    which = np.concatenate([which, stat.ravel()])
    value = np.concatenate([value, np.full(n * STATISTICS, 1 / STATISTICS**0.5)])
    order = np.argsort(at, kind="stable")
    return which[order].astype(np.int32), value[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


@dataclass
class Machine:
    """Weights of a factorisation machine: constant, linear, and a low-rank vector per feature."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, which: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of each row. Every row has its statistics, so no slice is empty."""
        if len(bounds) < 2:
            return np.zeros(0)
        at = bounds[:-1]
        vx = self.factors[which] * value[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        return self.bias + np.add.reduceat(self.linear[which] * value, at) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    """Fit on (label, feature numbers, values) by AdaGrad on small batches, in a fixed random order."""
    rng = np.random.default_rng(seed)
    linear = np.zeros(FEATURES, np.float32)
    factors = rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)
    share = np.clip(np.mean([y for y, *_ in rows]), 0.02, 0.98) if rows else 0.5
    model = Machine(float(np.log(share / (1 - share))), linear, factors)
    sum_l, sum_f = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = [rows[i] for i in order[lo : lo + BATCH]]
            which, value = (np.concatenate([r[k] for r in part]) for k in (1, 2))
            lengths = np.array([len(r[1]) for r in part])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            error = (sigmoid(model.raw(which, value, bounds)) - np.array([r[0] for r in part])) / len(part)
            vx = factors[which] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, bounds[:-1], axis=0), lengths, axis=0)
            step = (np.repeat(error, lengths) * value).astype(np.float32)
            used, back = np.unique(which, return_inverse=True)
            grad_l = np.bincount(back, step, len(used)).astype(np.float32) + DECAY * linear[used]
            push = step[:, None] * (sums - vx)
            grad_f = np.stack([np.bincount(back, push[:, k], len(used)) for k in range(RANK)], axis=1).astype(np.float32) + DECAY * factors[used]
            sum_l[used] += grad_l**2
            sum_f[used] += grad_f**2
            linear[used] -= 4 * RATE * grad_l / np.sqrt(sum_l[used])
            factors[used] -= RATE * grad_f / np.sqrt(sum_f[used])
            model.bias -= RATE * float(error.sum())
    return model


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    told = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), told.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.where((fold_column(doc_id, FOLDS) != HELD_OUT) & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = _inputs(docs, doc_id, text).join(F.broadcast(chosen), "doc_id")  # bounded by ``sample`` rows
    # of rows that share an id one stays, so what the driver gets is bounded by ``sample`` as well
    one = F.min(F.struct(F.xxhash64("text", "n_chars").alias("hash"), "text", "n_chars", "_label"))
    inputs = joined.groupBy("doc_id").agg(one.alias("row")).select("doc_id", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1 << 20):
            which, value, bounds = features(batch.column("text"), batch.column("n_chars"))
            ends = pa.array(bounds, pa.int32())
            made = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (which, value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), *made], names=["doc_id", "y", "which", "value"])

    got = inputs.select("doc_id", "_label", "text", "n_chars").mapInArrow(run, T.StructType([inputs.schema["doc_id"], *T.StructType.fromDDL("y int, which array<int>, value array<float>").fields])).toArrow()
    got = got.sort_by("doc_id")
    lists = [got[c].combine_chunks() for c in ("which", "value")]
    rows = [(y, lists[0][i].values.to_numpy(), lists[1][i].values.to_numpy()) for i, y in enumerate(got["y"].to_pylist())]
    return fit(rows)


def score(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of each row."""
    small_batches(docs.sparkSession)
    inputs = _inputs(docs, doc_id, text)
    kept = [f for f in inputs.schema.fields if f.name not in ("text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1 << 20):
            odds = shared.value.raw(*features(batch.column("text"), batch.column("n_chars")))
            scores = sigmoid(odds.astype(np.float64))
            columns = [*(batch.column(f.name) for f in kept), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return inputs.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns: a filter of each batch, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text, 1 << 20):
            told = batch.column("n_chars") if "n_chars" in batch.schema.names else pa.nulls(batch.num_rows, pa.float64())
            scores = sigmoid(shared.value.raw(*features(batch.column(text), told)).astype(np.float64))
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
