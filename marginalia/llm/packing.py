"""Packing of tokenised documents into sequences of a fixed length.

``token_pieces`` tokenises whole texts and cuts them at every ``limit`` tokens, so that only
the last piece of a document is short. ``pack`` puts pieces into sequences by first-fit
decreasing: pieces are dealt at random to groups of bounded size, and in each group a
tournament tree over the free room of the open sequences gives the first one that a piece
fits. Groups are independent, so they spread over all executors.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are
packed as often as they occur; ties in length go by the remaining columns; an empty table
gives no rows; other columns are left out of the pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import stage

from .common import fresh, small_batches, text_blocks, with_fields

GROUP_PIECES = 2048
#: Bytes of text that are tokenised at a time, and of known words and their ids that a task keeps.
BLOCK_BYTES, MEMO_BYTES = 1 << 22, 16 << 20
#: Words that the library is handed at a time.
WORD_BATCH = 4096
#: Letters of the first Unicode blocks and a stop, where the library's rules surely part the two.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]?$"
STOPS = [",", ".", ""]
#: How a vocabulary of words spells the end of one.
WORD_END = "</w>"


def spread(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``codes`` in a row, and where each ends; ``flat`` has those of word 0, 1, ... in turn, ``counts`` how many each has."""
    first = np.cumsum(counts) - counts
    lengths = counts[codes]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[codes] - (ends - lengths), lengths)
    return flat[at], ends


class WordIds:
    """Token ids of words, each tokenised once until the bounded memo, a table of words and their ids, is full.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its
    words in turn. Letters and a comma or full stop after them are tokens apart too, so a plain
    word is known with either. A word of letters ends with the first token spelled as the end
    of a word, so many of them are handed to the library as one text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        known = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[i for token, i in known.items() if token.endswith(WORD_END)]] = True
        self.start_anew()

    def start_anew(self) -> None:
        self.words, (self.flat, self.counts) = pa.array(STOPS, pa.string()), self.encode(STOPS)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` in a row, and how many each has."""
        each = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters."""
        ids, _ = self.encode([" ".join(words)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        return self.encode(words)  # a vocabulary that spells the end of a word otherwise

    def learn(self, words: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        found = [encode(words.slice(lo, WORD_BATCH).to_pylist()) for lo in range(0, len(words), WORD_BATCH)]
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, *(x for x, _ in found)])
        self.counts = np.concatenate([self.counts, *(x for _, x in found)])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` in a row, and how many each has."""
        if self.words.nbytes + self.flat.nbytes + self.counts.nbytes > MEMO_BYTES:
            self.start_anew()
        plain = pc.match_substring_regex(words, PLAIN)
        cut = pc.if_else(plain, pc.ascii_rtrim(words, ",."), words).dictionary_encode()
        rows = pc.fill_null(pc.index_in(cut.dictionary, self.words), -1).to_numpy().copy()
        letters = pc.match_substring_regex(cut.dictionary, PLAIN).to_numpy(zero_copy_only=False)
        for some, encode in ((letters, self.encode_letters), (~letters, self.encode)):
            new = some & (rows < 0)
            first = len(self.words)
            self.learn(cut.dictionary.filter(pa.array(new)), encode)
            rows[new] = np.arange(first, len(self.words))

        codes = np.full((len(words), 2), STOPS.index(""))
        codes[:, 0] = rows[cut.indices.to_numpy()]
        for i, stop in enumerate(STOPS[:2]):
            codes[pc.and_(plain, pc.ends_with(words, stop)).to_numpy(zero_copy_only=False), 1] = i
        flat, ends = spread(self.flat, self.counts, codes.ravel())
        return flat, np.diff(ends[1::2], prepend=0)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenise(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``texts`` in a row, and where each text begins and ends in them.

    A-Z are lowered before words are told apart, as the vocabulary does, but not where that
    could spell one of its special tokens.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    words = lists.flatten().dictionary_encode()
    flat, ends = spread(*word_ids(path).of(words.dictionary.cast(pa.string())), words.indices.to_numpy(zero_copy_only=False))
    offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    return flat, np.concatenate([[0], ends])[offsets]


def token_pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids.

    ``end_id`` follows the ids of each document. The crc32 is of the ids as little-endian
    unsigned 32-bit integers.
    """
    fields = "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", BLOCK_BYTES):
            ids, bounds = tokenise(batch.column("text"), path)
            row, out, held = [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.int32(end_id)).astype("<i4")
                for start in range(0, len(own), limit):
                    piece = own[start : start + limit]
                    row.append(i)
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                    held.append(piece)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))]
            if with_ids:
                ends = np.cumsum([0, *map(len, held)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
            del ids, held, columns
            pa.default_memory_pool().release_unused()  # workers live on, and what they keep adds up

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def first_fit(lengths: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each of ``lengths``, taken in the order given.

    Leaves of the tree are the free room of the bins; each node holds the most of its
    subtree, so going down leftwards finds the first bin with room in O(log n).
    """
    size = 1 << max(1, len(lengths) - 1).bit_length()
    room = [limit] * (2 * size)
    bins, offsets = [], []
    for n in map(int, lengths):
        i = 1
        while i < size:
            i *= 2
            if room[i] < n:
                i += 1
        bins.append(i - size)
        offsets.append(limit - room[i])
        room[i] -= n
        while i > 1:
            i >>= 1
            left, right = room[2 * i], room[2 * i + 1]
            room[i] = left if left > right else right
    return bins, offsets


def pack(pieces: DataFrame, limit: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (length at most ``limit``) with sequence_id and offset.

    Sequences are gapless from offset 0. The pieces are written once, as their number
    decides how many groups there are. Nested columns, such as the ids, are not handed to the groups but joined to their result.
    """
    small_batches(pieces.sparkSession)
    nested = [f.name for f in pieces.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        (row,) = fresh(pieces, "row")
        kept = [f.name for f in pieces.schema.fields if f.name.lower() not in ("sequence_id", "offset")]
        whole = stage(pieces.select(*kept, F.monotonically_increasing_id().alias(row)), "pieces-whole")
        placed = stage(pack(whole.drop(*nested), limit, group_pieces).select(row, "sequence_id", "offset"), "pieces-placed")
        return whole.join(placed, row).select(*kept, "sequence_id", "offset")
    staged = stage(pieces, "pieces")
    groups = max(1, -(-staged.count() // group_pieces))
    (name,) = fresh(staged, "group")
    group = F.pmod(F.xxhash64("start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias(name)
    kept = [f.name for f in staged.schema.fields if f.name.lower() not in ("sequence_id", "offset")]
    schema = with_fields(staged.schema, sequence_id=T.LongType(), offset=T.LongType())

    def run(key: tuple, found: pa.Table) -> pa.Table:
        found = found.select(kept)
        order = [(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]
        found = found.take(pc.sort_indices(found, sort_keys=[("length", "descending"), *order]))
        bins, offsets = first_fit(found["length"].to_numpy(), limit)
        first = key[0].as_py() << 32
        return found.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return staged.select("*", group).groupBy(name).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 2, with_ids: bool = True, **columns: str) -> DataFrame:
    """Tokenise, cut and pack ``docs``; see token_pieces and pack."""
    return pack(token_pieces(docs, path, limit, end_id, with_ids=with_ids, **columns), limit)
