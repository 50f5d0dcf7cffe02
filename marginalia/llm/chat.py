"""Chat formatting over a prefix tree of conversations.

A turn is written ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end. Control
strings inside a text get a backslash after their ``<``; reading takes it out again.

Conversations that share their first turns share nodes of a tree, one node per distinct
sequence of turns. A node's tokens are emitted once, in depth-first order of its tree: ``offset``
is its place there, ``position`` the position id of its first token (ids go on from its
parent's last), and ``ancestors`` are the intervals of the tree's tokens that it may attend
to beside its own earlier ones. Loss is on assistant texts.

Depth-first order needs no tree in memory. Conversations are ranked by their turns, up to the first that
no other shares: names of pairs of neighbouring turns, in order, make names of twice the length,
round after round, each half the size of the one before (Karp, Miller and Rosenberg, "Rapid
Identification of Repeated Patterns"). Nodes are sorted by the least rank among their conversations and
their depth, and offsets are running sums over that order by range, with the ranges' totals added.
So a first turn that very many conversations share is no hot spot, and long shared beginnings
cost no more than their turns. A single conversation is read in order by one task, as a stream of digests.

Defined results: null texts and roles count as empty; turns go by turn, then role, then text,
nulls first, and repeated rows are turns of their own; null ids form one conversation; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.staging import settle, stage

from .bpe import vocabulary
from .common import small_batches, text_blocks

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"
DIGEST = 32
#: Bytes of text that are tokenised at a time, and roles that a task remembers.
BLOCK_BYTES, ROLES = 1 << 20, 512


def escape(text: str) -> str:
    """``text`` without control strings: every ``<``, backslashes, ``|`` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def head(role: str) -> str:
    """The opening of a turn; a line end in a role is written as a backslash and n."""
    return START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def read_head(line: str) -> str:
    role = unescape(line.removeprefix(START))
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (segment.startswith(START) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    first, _, rest = segment[: -len(END)].partition("\n")
    if START in rest or "<|im_end|>" in rest:
        raise ValueError("a control string inside a turn")
    return read_head(first), unescape(rest)


@lru_cache(maxsize=2)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encoded(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(e.ids, np.int32) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _turned(turns: DataFrame, path: str) -> DataFrame:
    """Each turn with what it says in one digest, its tokens, and the interval of them under the loss."""
    inputs = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = T.StructType([*inputs.schema.fields, *T.StructType.fromDDL("digest binary, n_tokens int, loss_start int, loss_end int, tokens array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (closing,) = encoded([END], path)
        heads: dict[str, np.ndarray] = {}
        for batch in text_blocks(batches, "text", BLOCK_BYTES):
            roles, texts = batch.column("role").to_pylist(), list(map(escape, batch.column("text").to_pylist()))
            if len(heads) > ROLES:
                heads.clear()
            new = list({r for r in roles if r not in heads})
            heads.update(zip(new, encoded(list(map(head, new)), path), strict=True))
            bodies = encoded(texts, path)
            digests = [hashlib.sha256((head(r) + t).encode()).digest() for r, t in zip(roles, texts, strict=True)]
            begin = np.array([len(heads[r]) for r in roles])
            end = begin + np.array(list(map(len, bodies)))
            loss = np.array([r == ASSISTANT for r in roles])
            tokens = listed([part for r, body in zip(roles, bodies, strict=True) for part in (heads[r], body, closing)]).values
            sizes = end + len(closing)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens)
            made = [pa.array(digests, pa.binary()), *(pa.array(x, pa.int32()) for x in (sizes, begin * loss, end * loss)), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return inputs.mapInArrow(run, schema)


def _chained(turned: DataFrame) -> DataFrame:
    """Each turn as a step of its conversation: pos, node (digest of all turns so far), parent, tree (the first node) and position."""
    ordered = turned.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    ordered = ordered.select("conv", "conv_id", "n_tokens", "loss_start", "loss_end", "tokens", "digest")
    kept = ordered.columns[:-1]
    schema = T.StructType([*ordered.schema.fields[:-1], *T.StructType.fromDDL("pos int, node string, parent string, tree string, position long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, node, tree, position = None, 0, "", "", 0
        for batch in batches:
            made: list[tuple] = []
            for c, digest, n in zip(*(batch.column(k).to_pylist() for k in ("conv", "digest", "n_tokens")), strict=True):
                if c != conv:
                    conv, pos, node, position = c, 0, "", 0
                parent, node = node, hashlib.sha256(node.encode() + digest).hexdigest()[:DIGEST]
                tree = tree if pos else node
                made.append((pos, node, parent, tree, position))
                pos, position = pos + 1, position + n
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names=schema.names)

    return ordered.mapInArrow(run, schema)


def _ranked(steps: DataFrame) -> DataFrame:
    """conv and rank: the order of the conversations by their turns, a beginning before what goes on from it."""
    spark = steps.sparkSession
    uses = stage(steps.groupBy("node").agg(F.count("*").alias("uses")), "chat-uses")
    on_path = stage(steps.select("conv", "pos", "node").join(uses, "node"), "chat-on-path")
    own = on_path.where("uses = 1").groupBy("conv").agg(F.min(F.struct("pos", "node")).alias("x")).select("conv", "x.pos", "x.node")
    told = on_path.where("uses > 1").select("conv", "pos", "node").union(own)
    now = stage(told.select("conv", F.col("pos").alias("i"), F.col("node").alias("name")), "chat-names")
    for _ in range((now.agg(F.max("i")).first()[0] or 0).bit_length()):
        now = settle(spark, "chat-names", lambda now=now: _doubled(now))
    return now.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").select("conv", F.monotonically_increasing_id().alias("rank"))


def _doubled(now: DataFrame) -> DataFrame:
    """``now`` (conv, i, name) with one name for each pair of neighbours, in the order of the pairs."""
    even = F.col("i") % 2 == 0
    pairs = stage(now.groupBy("conv", F.expr("cast(i div 2 as int)").alias("i")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")), "chat-pairs")
    names = pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    names = stage(names.select(F.col("a").alias("x"), F.col("b").alias("y"), F.monotonically_increasing_id().alias("name")), "chat-named")
    return pairs.join(names, (F.col("a") == F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("conv", "i", "name")


def _running(ordered: DataFrame) -> DataFrame:
    """node, tree, conv, part, and tokens before and up to the node in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("node", "tree", "conv")), pa.array(np.full(len(n), part), pa.int32()), pa.array(before), pa.array(before + n)], names=["node", "tree", "conv", "part", "within", "until"]
            )

    return ordered.mapInArrow(run, "node string, tree string, conv string, part int, within long, until long")


def _layout(steps: DataFrame) -> DataFrame:
    """node, owner (the conversation that emits it), tree (its root) and offset in the tree."""
    ranked = settle(steps.sparkSession, "chat-ranked", lambda: _ranked(steps))
    owned = steps.select("conv", "pos", "node", "tree", "n_tokens").join(ranked, "conv").groupBy("node").agg(F.min(F.struct("rank", "conv")).alias("first"), *(F.first(c).alias(c) for c in ("tree", "pos", "n_tokens")))
    nodes = stage(owned.select("node", "tree", "first.conv", "first.rank", "pos", "n_tokens"), "chat-nodes")
    placed = stage(_running(nodes.repartitionByRange("rank", "pos").sortWithinPartitions("rank", "pos")), "chat-running")
    parts = placed.groupBy("part").agg(F.max("until").alias("tokens"))
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    overall = stage(placed.join(F.broadcast(parts.select("part", base.alias("base"))), "part").select("node", "tree", "conv", (F.col("base") + F.col("within")).alias("place")), "chat-overall")  # a row per range
    roots = stage(overall.where("node = tree").select("tree", F.col("place").alias("root")), "chat-roots")
    return overall.join(roots, "tree").select("node", F.col("conv").alias("owner"), "tree", (F.col("place") - F.col("root")).alias("offset"))


def _ancestry(steps: DataFrame, layout: DataFrame) -> DataFrame:
    """conv, pos, tree, offset and ancestors (merged intervals) of each node, at the step that emits it."""
    joined = steps.select("conv", "pos", "node", "n_tokens").join(layout, "node").repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, spans = None, []
        for batch in batches:
            at, low, high, bounds = [], [], [], [0]
            for i, (c, owner, offset, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("conv", "owner", "offset", "n_tokens")), strict=True)):
                if c != conv:
                    conv, spans = c, []
                if owner == c:
                    at.append(i)
                    low += [a for a, _ in spans]
                    high += [b for _, b in spans]
                    bounds.append(len(low))
                if spans and spans[-1][1] == offset:
                    spans[-1] = (spans[-1][0], offset + n)
                else:
                    spans.append((offset, offset + n))
            pairs = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["start", "end"])
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in ("conv", "pos", "tree", "offset")]
            yield pa.RecordBatch.from_arrays([*taken, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], names=["conv", "pos", "tree", "offset", "ancestors"])

    return joined.mapInArrow(run, "conv string, pos int, tree string, offset long, ancestors array<struct<start:long,end:long>>")


def format_conversations(turns: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and paths of ``turns`` (conv_id, turn, role, text), tokenised with the vocabulary at ``path``.

    Nodes: node, parent ("" at a root), tree, offset, position, n_tokens, tokens, loss_start and
    loss_end (the interval of ``tokens`` under the loss), ancestors. Paths: conv, conv_id, pos, node,
    from a conversation's first turn to its last.
    """
    spark = turns.sparkSession
    small_batches(spark)
    steps = stage(_chained(_turned(turns, path)), "chat-steps")

    def nodes() -> DataFrame:
        own = stage(_ancestry(steps, stage(_layout(steps), "chat-layout")), "chat-placed")
        return steps.drop("tree").join(own, ["conv", "pos"]).select("node", "parent", "tree", "offset", "position", "n_tokens", "tokens", "loss_start", "loss_end", "ancestors")

    return settle(spark, "chat-formatted", nodes), steps.select("conv", "conv_id", "pos", "node")


def _read(nodes: DataFrame, path: str) -> DataFrame:
    """node, said (role, line end, text, line end), learned (the text under the loss) and formatted (code points) of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary(path).bytes_of.__getitem__
        for batch in batches:
            said, learned, formatted = [], [], []
            tokens = batch.column("tokens")
            for i, (a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("loss_start", "loss_end")), strict=True)):
                ids = tokens[i].values.to_numpy(zero_copy_only=False).tolist()
                front, middle, back = (b"".join(map(spelled, x)) for x in (ids[:a], ids[a:b], ids[b:]))
                segment = (front + middle + back).decode("utf-8", "replace")
                said.append("{}\n{}\n".format(*read_turn(segment)))
                learned.append(unescape(middle.decode("utf-8", "replace")))
                formatted.append(len(segment))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(said, pa.string()), pa.array(learned, pa.string()), pa.array(formatted, pa.int64())], names=["node", "said", "learned", "formatted"])

    return nodes.select("node", "tokens", "loss_start", "loss_end").mapInArrow(run, "node string, said string, learned string, formatted long")


def read_back(nodes: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = paths.join(_read(nodes, path), "node").repartition("conv").sortWithinPartitions("conv", "pos").drop("node")

    def row(conv_id: int | None, n: int, turns, chars: int, loss, formatted: int) -> dict:
        return {"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, conv_id, said, learned, n in zip(*(batch.column(k).to_pylist() for k in ("conv", "conv_id", "said", "learned", "formatted")), strict=True):
                if c != conv:
                    if state:
                        done.append(row(*state))
                    conv, state = c, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(said.encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += n
            yield pa.RecordBatch.from_pylist(done, schema=TOLD)
        if state:
            yield pa.RecordBatch.from_pylist([row(*state)], schema=TOLD)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TOLD = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
