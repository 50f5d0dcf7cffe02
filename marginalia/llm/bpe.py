"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

``encode`` adds the token ids of every whole text, ``decode`` the text of every id list. The
new words of a block of texts are merged together, their trees side by side in a matrix.
The vocabulary is a public tokenizer file (byte-level BPE, no normaliser); its path is
a parameter. Ids equal those of the tokenizers library with add_special_tokens=False.

Defined results: a null or empty text has an empty id list; a null id list decodes to
empty text; rows are kept one to one, repeated rows included; other columns pass through,
and an input column with the name of an output column is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import put_columns, small_batches, text_blocks, with_fields

#: Fixed value: the split pattern of this family of byte-level vocabularies. Letters, the most frequent, are tried first;
#: the order matters only among branches that can start alike.
PATTERN = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these ranges the Unicode tables of regex and of the tokenizers library may
#: differ, so a text with such a character is split by the library's own pre-tokenizer.
UNSURE = r"[^\x00-՗‐-⁤ぁ-ゖァ-ヺ一-鿿가-힣]"
NO_PAIR = 1 << 62
MEMO_WORDS, MEMO_CHARS = 1 << 18, 64
#: Bytes of text whose words are met together, and words whose trees are kept side by side; fewer than FEW have a tree each.
BLOCK_BYTES, TREES, FEW = 1 << 20, 4096, 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int], width: int) -> list[int]:
    """Merge pairs in ``symbols``, the lowest rank first and of equal ranks the leftmost.

    ``ranks`` maps left * width + right to a rank, ``merged`` a rank to the new symbol.
    Leaf i of the tree holds rank * n + i of the pair that starts at symbol i, so the root
    is the pair to merge next. A merge updates three leaves; all is O(n log n).
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * size)
    rank_of = ranks.get
    for i in range(n - 1):
        r = rank_of(symbols[i] * width + symbols[i + 1])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != NO_PAIR:
        r, i = divmod(root, n)
        j = after[i]
        k = after[j]
        symbols[i], symbols[j] = merged[r], -1
        after[i] = k
        here = before_here = NO_PAIR
        if k < n:
            before[k] = i
            if (r := rank_of(symbols[i] * width + symbols[k])) is not None:
                here = r * n + i
        h = before[i]
        if h < 0:
            h = i
        else:
            if (r := rank_of(symbols[h] * width + symbols[i])) is not None:
                before_here = r * n + h
            tree[size + h] = before_here
        tree[size + i] = here
        if j == n - 1:
            j = i
        else:
            tree[size + j] = NO_PAIR
        x, y, z = size + h, size + i, size + j  # up from the three leaves; their paths soon meet
        while x > 1:
            x, y, z = x >> 1, y >> 1, z >> 1
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b
            if y != x:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if z != y:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a < b else b
    return [s for s in symbols if s >= 0]


class Forest:
    """``merge`` for many words at a time: the trees of equally large words are rows of one matrix.

    Symbols stand at places 1 to n of their row, between places that hold ``none``, which no pair
    has, so that the ends of a word need no case of their own.
    """

    def __init__(self, ranks: dict[int, int], merged: list[int], byte_ids: list[int], width: int):
        self.pairs = np.array([*sorted(ranks), NO_PAIR])
        self.rank = np.array([*(ranks[p] for p in self.pairs[:-1].tolist()), 0])
        self.merged, self.byte_ids = np.array(merged, np.int64), np.array(byte_ids, np.int64)
        self.width, self.none = width, width - 1

    def leaves(self, left: np.ndarray, right: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """rank * size + place of each pair, or NO_PAIR."""
        pairs = left * self.width + right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.rank[at] * size + places, NO_PAIR)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` in a row, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size = 1 << int(lengths.max()).bit_length()  # more than the longest
        places = np.arange(size + 1)
        symbols = np.full((len(words), size + 1), self.none)
        symbols[(places > 0) & (places <= lengths[:, None])] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        trees = np.full((len(words), 2 * size), NO_PAIR)
        trees[:, size:] = self.leaves(symbols[:, :-1], symbols[:, 1:], places[:-1], size)
        half = size
        while half > 1:
            trees[:, half // 2 : half] = np.minimum(trees[:, half : 2 * half : 2], trees[:, half + 1 : 2 * half : 2])
            half //= 2
        after, before = np.tile(places + 1, (len(words), 1)), np.tile(places - 1, (len(words), 1))

        rows = np.arange(len(words))
        while True:
            root = trees[rows, 1]
            more = root != NO_PAIR
            rows = rows[more]
            if not len(rows):
                break
            rank, i = np.divmod(root[more], size)
            h, j = before[rows, i], after[rows, i]
            k = after[rows, j]
            new = self.merged[rank]
            symbols[rows, i], symbols[rows, j] = new, self.none
            after[rows, i], before[rows, k] = k, i
            trees[rows, size + h] = self.leaves(symbols[rows, h], new, h, size)
            trees[rows, size + i] = self.leaves(new, symbols[rows, k], i, size)
            trees[rows, size + j] = NO_PAIR
            up = [size + h, size + i, size + j]
            while up[0][0] > 1:
                up = [x >> 1 for x in up]
                for x in up:
                    trees[rows, x] = np.minimum(trees[rows, 2 * x], trees[rows, 2 * x + 1])
        kept = symbols != self.none
        return symbols[kept].astype(np.int32), kept.sum(axis=1)


class Vocabulary:
    """One tokenizer file, ready for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.width = max(ids.values()) + 2  # one more than the ids, for no symbol
        self.ranks = {ids[a] * self.width + ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        shown = byte_characters()
        self.byte_ids = [ids[c] for c in shown]
        self.forest = Forest(self.ranks, self.merged, self.byte_ids, self.width)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        back = {c: bytes([b]) for b, c in enumerate(shown)}
        self.bytes_of = [b""] * (max([self.width - 1, *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = b"".join(back.get(c, c.encode()) for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.unsure = regex.compile(UNSURE).search
        self.memo = Memo(self)
        self._splitter = None
        self.path = path

    def split(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self.words(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def encode_word(self, word: str) -> list[int]:
        return merge([self.byte_ids[b] for b in word.encode()], self.ranks, self.merged, self.width)

    def parts(self, text: str) -> list[list[str] | int]:
        """``text`` as lists of words and the ids of special tokens between them."""
        found, start = [], 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            found += [self.split(text[start : m.start()]), self.special[m[0]]]
            start = m.end()
        return [*found, self.split(text[start:] if start else text)]

    def encode_parts(self, parts: list[list[str] | int], out: array) -> None:
        for part in parts:
            if isinstance(part, int):
                out.append(part)
            else:
                out.frombytes(b"".join(map(self.memo.__getitem__, part)))

    def encode(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        self.encode_parts(self.parts(text), out)

    def encode_all(self, texts: Iterable[str | None], out: array) -> list[int]:
        """Append the ids of all ``texts`` to ``out``; where each begins and ends there. New words are merged together."""
        split = [self.parts(text) if text else [] for text in texts]
        self.memo.learn(set(chain.from_iterable(part for parts in split for part in parts if not isinstance(part, int))))
        ends = [len(out)]
        for parts in split:
            self.encode_parts(parts, out)
            ends.append(len(out))
        return ends

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Memo(dict):
    """Ids of words met in this task, four bytes each; bounded, as it starts anew when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.encode, self.forest = vocabulary.encode_word, vocabulary.forest

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.encode(word)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Know ``words``, but for long ones."""
        new = [w for w in words if w not in self and len(w) <= MEMO_CHARS]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = [w for w in words if len(w) <= MEMO_CHARS]
        if len(new) < FEW:
            return
        new.sort(key=len)
        for lo in range(0, len(new), TREES):
            some = new[lo : lo + TREES]
            ids, counts = self.forest.merge([w.encode() for w in some])
            held, ends = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            self.update((w, held[a:b]) for w, (a, b) in zip(some, pairwise(ends), strict=True))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text in ``ids``.

    With ``decoded`` the ids are decoded again at once, into a column of that name.
    """
    fields = {ids: T.ArrayType(T.IntegerType(), False)} | ({decoded: T.StringType()} if decoded else {})
    schema = with_fields(docs.schema, **fields)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in text_blocks(batches, text, BLOCK_BYTES):
            flat = array("i")
            ends = known.encode_all(batch.column(text).to_pylist(), flat)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
            made = {ids: lists}
            if decoded:
                made[decoded] = pa.array([known.decode(flat[a:b]) for a, b in pairwise(ends)], pa.string())
            yield put_columns(batch, **made)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list in ``text``; special tokens are kept."""
    schema = with_fields(docs.schema, **{text: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [known.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(ids)]
            yield put_columns(batch, **{text: pa.array(texts, pa.string())})

    return docs.mapInArrow(run, schema)
