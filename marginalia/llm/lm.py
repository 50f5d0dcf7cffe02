"""Language-model scores by a subword lattice.

The probability of a text is summed over all ways to spell it with the pieces of an existing
vocabulary, each piece drawn independently (a unigram model), the text closed by an end piece. Words
begin with a mark of their own, so no piece spans two words and the sum is a product of sums
per distinct word: a forward recursion in log space over the word's lattice. Bytes spell
what has no piece, so every text has a probability above 0.

The vocabulary's stored scores give the prior: of a unigram file the log probabilities themselves; a file made by
merging stores whole numbers, a merge's place, of which e^score would leave the first few
pieces alone, so there a share is 1 / (RANK_SHIFT - score). ROUNDS of expectation maximisation over
all distinct words of the training texts, weighted by count and with the prior as PRIOR tokens, turn it
into the model. Pieces are a fixed number, so only they reach the driver.

Words are counted in blocks of documents: a block's texts become numbers into its own word
list, the lists are summed up and joined on the cluster, and each block then looks its
words up in its part of the result. Nothing is kept that grows with the corpus in one place.

Defined results: null text counts as empty, which has the end alone; repeated rows count
and score once each; a null id folds as empty text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import stage

from .common import fold, small_batches, text_blocks

FOLDS, HELD_OUT = 5, 1
ROUNDS, PRIOR, RANK_SHIFT = 4, 1000.0, 10.0
BLOCK_BYTES, WORD_BATCH = 16 << 20, 4096
MARK = "▁"
LOG10 = np.log(10)


class Lattice:
    """Pieces of a vocabulary as a trie whose steps are looked up for many words at once."""

    def __init__(self, pieces: list[str], byte_pieces: list[int]):
        """``pieces`` by number; those in ``byte_pieces`` (number by byte) and empty ones are no strings to match."""
        steps: dict[int, int] = {}
        accepts = [-1]
        skip = set(byte_pieces)
        for number, piece in enumerate(pieces):
            if number in skip or not piece:
                continue
            state = 0
            for c in piece:
                state = steps.setdefault(state << 21 | ord(c), len(accepts))
                if state == len(accepts):
                    accepts.append(-1)
            accepts[state] = number
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.accepts = np.array(accepts)
        self.size, self.byte_pieces = len(pieces), byte_pieces

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of the words' lattices: from and to node, piece (or -1 - place for a character spelled in
        bytes), and the first and last node of each word. A word of n characters has n + 1 nodes."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.repeat(np.cumsum(lengths), lengths)
        shift = np.repeat(np.arange(len(words)), lengths)  # nodes before a word exceed its characters by the words before
        here = np.arange(len(chars))
        start, end, piece = [here], [here + 1], [-1 - here]
        begin, state, length = here, np.zeros(len(chars), np.int64), 0
        while len(begin):
            key = state << 21 | chars[begin + length]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            begin, state = begin[found], self.next[at[found]]
            length += 1
            good = self.accepts[state] >= 0
            start.append(begin[good])
            end.append(begin[good] + length)
            piece.append(self.accepts[state[good]])
            inside = begin + length < ends[begin]
            begin, state = begin[inside], state[inside]
        start, end, piece = (np.concatenate(x) for x in (start, end, piece))
        shift = shift[start]
        first = np.cumsum(lengths) - lengths + np.arange(len(words))
        self.chars = chars
        return start + shift, end + shift, piece, first, first + lengths

    def spelled(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Log probability in bytes of each character of the last words; distinct characters and their places."""
        distinct, which = np.unique(self.chars, return_inverse=True)
        in_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in distinct]
        weights = np.array([sum(logp[self.byte_pieces[b]] for b in x) for x in in_bytes])
        return (weights[which] if len(which) else np.zeros(0)), which, in_bytes

    def weights(self, piece: np.ndarray, logp: np.ndarray) -> np.ndarray:
        by_bytes, _, _ = self.spelled(logp)
        return np.where(piece >= 0, logp[np.maximum(piece, 0)], by_bytes[np.maximum(-1 - piece, 0)] if len(by_bytes) else 0.0)

    def log_likelihood(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        start, end, piece, first, last = self.edges(words)
        return sweep(start, end, self.weights(piece, logp), first, last)[last]

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, weighted by ``counts``."""
        start, end, piece, first, last = self.edges(words)
        weight = self.weights(piece, logp)
        ahead = sweep(start, end, weight, first, last)
        top = int(last[-1]) if len(last) else 0
        behind = sweep(top - end, top - start, weight, (top - last)[::-1], (top - first)[::-1])[::-1]  # the same recursion on the mirrored lattice
        word = np.searchsorted(first, start, side="right") - 1
        share = np.exp(ahead[start] + weight + behind[end] - ahead[last][word]) * counts[word]
        plain = piece >= 0
        out = np.bincount(piece[plain], share[plain], self.size)
        _, which, in_bytes = self.spelled(logp)
        by_char = np.bincount(which[-1 - piece[~plain]], share[~plain], len(in_bytes))
        for x, n in zip(in_bytes, by_char, strict=True):
            for b in x:
                out[self.byte_pieces[b]] += n
        return out


def sweep(start: np.ndarray, end: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Forward recursion in log space: of each node the log sum over all paths from its word's first node.

    Step t does the t-th node of every word at once.
    """
    total = np.full(int(last[-1]) + 1 if len(last) else 0, -np.inf)
    total[first] = 0.0
    depth = end - first[np.searchsorted(first, end, side="left") - 1]
    order = np.lexsort((end, depth))
    start, end, weight, depth = start[order], end[order], weight[order], depth[order]
    steps = np.flatnonzero(np.diff(depth, prepend=0))
    for lo, hi in zip(steps, [*steps[1:], len(depth)], strict=True):
        value = total[start[lo:hi]] + weight[lo:hi]
        nodes = end[lo:hi]
        cuts = np.flatnonzero(np.diff(nodes, prepend=-1))
        most = np.maximum.reduceat(value, cuts)
        value = np.exp(value - np.repeat(most, np.diff(cuts, append=len(value))))
        total[nodes[cuts]] = most + np.log(np.add.reduceat(value, cuts))
    return total


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Lattice, np.ndarray, int]:
    """The lattice of a sentencepiece file, the prior share of each piece, and the number of the end piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    by_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    known = set(plain)
    pieces = [model.id_to_piece(i) if i in known else "" for i in range(size)]
    share = np.zeros(size)
    share[plain] = prior(np.array([model.get_score(i) for i in plain]))
    share[by_byte] = share[plain].min()
    end = model.eos_id()
    share[end] = share.max()
    return Lattice(pieces, by_byte), share / share.sum(), end


def prior(scores: np.ndarray) -> np.ndarray:
    """The share of each piece, up to a factor, that the vocabulary's stored scores give."""
    below = scores.max() - scores
    return 1 / (RANK_SHIFT + below) if (below == np.round(below)).all() else np.exp(-below)


def marked(words: list[str]) -> list[str]:
    return [MARK + w for w in words]


def planes(codes: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first. Most are small, so the other planes compress to little."""
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least BLOCK_BYTES of text, but for the last: a block's word list is written once."""
    held, size = [], 0
    for batch in text_blocks(batches, "text"):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents by block: their ids and folds, their words as numbers (see planes), and the block's word list,
    frequent words first, with training counts."""
    schema = "block long, ids array<long>, held array<boolean>, bounds array<int>, codes binary, words array<string>, trained array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(gathered(batches)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            flat = lists.flatten()
            real = pc.greater(pc.binary_length(flat), 0)
            before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
            offsets = lists.offsets.to_numpy()
            bounds = before[offsets - offsets[0]]
            coded = flat.filter(real).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            common = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
            place = np.empty_like(common)
            place[common] = np.arange(len(common))
            codes = place[codes]
            ids = batch.column("doc_id").to_pylist()
            held = np.array([fold(i, FOLDS) == HELD_OUT for i in ids])
            trained = np.bincount(codes, np.repeat(~held, np.diff(bounds)), len(common)).astype(np.int64)
            offset = pa.array([0, len(common)], pa.int32())
            columns = {
                "block": pa.array([part << 32 | n], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "bounds": pa.array([bounds.astype(np.int32)]),
                "codes": pa.array([planes(codes)], pa.binary()), "words": pa.ListArray.from_arrays(offset, coded.dictionary.take(pa.array(common))), "trained": pa.ListArray.from_arrays(offset, pa.array(trained)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def train(words: DataFrame, ends: int, path: str) -> np.ndarray:
    """Natural-log probabilities of the pieces, from ``words`` (word, c) and the number of texts that end."""
    lattice, share, end = vocabulary(path)
    some = words.where("c > 0").select("word", "c")
    for _ in range(ROUNDS):
        logp = np.log(np.maximum(share, 1e-300))

        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            known = vocabulary(path)[0]
            total = np.zeros(known.size)
            for batch in batches:
                for lo in range(0, batch.num_rows, WORD_BATCH):
                    part = batch.slice(lo, WORD_BATCH)
                    total += known.expected(marked(part.column("word").to_pylist()), part.column("c").to_numpy(zero_copy_only=False), logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

        got = some.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row per piece
        counts = PRIOR * vocabulary(path)[1]
        counts[got["piece"].to_numpy()] += got["n"].to_numpy()
        counts[end] += ends
        share = counts / counts.sum()
    return np.log(np.maximum(share, 1e-300))


def score(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learned from the texts outside the held-out fold: ``base_score`` is the log10 probability
    under smoothed word counts, ``score`` that under the lattice model.
    """
    small_batches(docs.sparkSession)
    numbered = stage(blocks(docs, doc_id, text), "lm-blocks")
    ends = numbered.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()[0] or 0
    counted = numbered.select(F.explode(F.arrays_zip("words", "trained")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.trained").alias("c"))
    words = stage(counted, "lm-words")
    seen, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, kinds = int(seen or 0) + ends, int(distinct or 0) + (ends > 0)
    logp = train(words, ends, path)
    end_logp = float(logp[vocabulary(path)[2]])
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # a number per piece

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)[0]
        for batch in batches:
            for lo in range(0, batch.num_rows, WORD_BATCH):
                part = batch.slice(lo, WORD_BATCH)
                found = known.log_likelihood(marked(part.column("word").to_pylist()), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=["word", "c", "logp"])

    scored = stage(words.mapInArrow(likelihoods, "word string, c long, logp double"), "lm-scored")
    wanted = numbered.select("block", F.posexplode("words").alias("place", "word"))
    looked_up = wanted.join(scored, "word").select(F.col("block").alias("of_block"), "place", "c", "logp")
    below = np.log10(total + 0.5 * (kinds + 1))

    def finish(texts: pa.Table, words: pa.Table) -> pa.Table:
        c, lp = np.zeros(words.num_rows), np.zeros(words.num_rows)
        place = words["place"].to_numpy()
        c[place], lp[place] = words["c"].to_numpy(), words["logp"].to_numpy()
        values = (np.log10(c + 0.5) - below, lp / LOG10, (c > 0).astype(np.float64))
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for n in range(texts.num_rows):
            bounds, codes = texts["bounds"][n].values.to_numpy(), from_planes(texts["codes"][n].as_py())
            sums = np.zeros((len(bounds) - 1, 3))
            some = np.flatnonzero(np.diff(bounds))
            for k in range(3) if len(some) else ():
                sums[some, k] = np.add.reduceat(values[k][codes], bounds[some])
            out["doc_id"] += texts["ids"][n].as_py()
            out["held_out"] += texts["held"][n].as_py()
            out["n_tokens"] += (np.diff(bounds) + 1).tolist()
            out["n_known"] += (np.rint(sums[:, 2]).astype(np.int64) + (ends > 0)).tolist()
            out["base_score"] += (sums[:, 0] + np.log10(ends + 0.5) - below).tolist()
            out["score"] += (sums[:, 1] + end_logp / LOG10).tolist()
        out["train_tokens"] = [total] * len(out["doc_id"])
        return pa.Table.from_pydict(out, schema=RESULT)

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = numbered.select("block", "ids", "held", "bounds", "codes")
    return texts.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(finish, T.StructType.fromDDL(fields))


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
