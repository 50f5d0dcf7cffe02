"""Secret scans with multipart credential linking.

Base patterns report on their own: assignments of a secret to a telling name (whose value, the
second group, has 12 characters at least), access identifiers, and long hex runs. A credential
often has several parts, of which some are weak evidence alone. Such candidates are reported only
when complementary parts lie within SCOPE code points of them in the same text:

* ``ident``: a telling name with an identifier (user, account, client), near an assignment or a key;
* ``key``: a run of 32 or more base64 characters that holds a digit, a lower-case and an
  upper-case letter, near an identifier (``access`` or ``ident``) or near an endpoint that itself is near one;
* ``endpoint``: a URL or a host of a service form, near an assignment, or near both an access identifier and
  a hex run or key, or near both an ``ident`` and a key.

Distance is the gap between the intervals of two parts, so a long part does not hide its neighbours.
Linking is an interval join: a part is entered in each cell of SCOPE code points from its start to
its end, cut to the cell, and cells are summed up to the first and last place of each role. A
candidate asks in its own cells and the two around them. Within a cell all is near enough, and of
the neighbours only the nearest place counts, so existence is decided exactly without listing
pairs, however many parts a text holds.

All is DataFrame functions, in time linear in the matches of a text (see running). Defined results:
null text counts as empty and has no spans; repeated rows each have a row; spans are in code points
with exclusive ends; other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.staging import stage

from .common import fresh, text_or_empty

SCOPE = 400
KINDS = ("assign", "access", "hex", "key", "endpoint", "ident")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}|[a-z0-9][a-z0-9.-]*\.(?:amazonaws\.com|googleapis\.com|core\.windows\.net|cloud\.internal|storage\.example\.com))"
IDENT = r"""(?i:access_key_id|client_id|account_id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+_.@-]{4,}"""
#: How the names of ASSIGN and IDENT end, with what follows: quick to look for.
NAMED = r"""[DdEeNnRrTtYy]["']?\x20*[:=]"""
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Items of a text's array that are folded together; see running.
CHUNK = 128


def running(items: F.Column, zero: F.Column, fold, emit) -> F.Column:
    """``emit(states, chunk)`` of each CHUNK of ``items``, flattened: ``states`` is the state that ``fold`` had before it.

    A fold that appends to an array copies it at each step; two levels keep the copies short.
    """
    cut = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK)), lambda i: F.slice(items, i + 1, F.lit(CHUNK)))

    def split(chunks: F.Column) -> F.Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("before"))

        def step(acc: F.Column, chunk: F.Column) -> F.Column:
            return F.struct(F.aggregate(chunk, acc["now"], fold).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before"))

        return F.flatten(F.zip_with(chunks, F.aggregate(chunks, start, step, lambda acc: acc["before"]), lambda chunk, before: emit(before, chunk)))

    return F.when(F.size(items) > 0, bound(cut, split))


def bound(value: F.Column, body) -> F.Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(text: F.Column) -> F.Column:
    """Whether ASSIGN or IDENT may match; most texts end the search at the first, cheapest step."""
    return (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & F.regexp_like(text, F.lit(NAMED))


def linkable(text: F.Column) -> F.Column:
    """Whether a text holds an assignment or identifier, which every linked span needs."""
    return F.contains(text, F.lit("AKIA")) | _named(text) & F.regexp_like(text, F.lit(f"{ASSIGN}|{IDENT}"))


def found(text: F.Column, pattern: str, kind: int, good=None, group: int = 0, may: F.Column | None = None) -> F.Column:
    """Spans of the leftmost non-overlapping matches of ``pattern`` whose ``group`` is ``good``.

    Splitting by the pattern gives what lies between the matches; running sums of both
    lengths are the places. Texts without a match, nearly all, are not split; where ``may`` is
    false there is none, which spares the search.
    """
    gaps = F.split(text, pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    columns = [F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), judged.alias("judged")]
    measured = F.transform(
        F.arrays_zip(*columns),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), (F.lit(True) if good is None else good(x["judged"])).alias("good")),
    )

    def spans(at: F.Column, chunk: F.Column) -> F.Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(acc: F.Column, x: F.Column) -> F.Column:
            begin = acc["at"] + x["gap"]
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["n"]).alias("end")))
            return F.struct((begin + x["n"]).alias("at"), F.when(x["good"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(chunk, start, step, lambda acc: acc["spans"])

    listed = bound(measured, lambda items: running(items, F.lit(0), lambda at, x: at + x["gap"] + x["n"], spans))
    has = F.regexp_like(text, F.lit(pattern))
    return F.when(has if may is None else may & has, listed).otherwise(F.array().cast(SPAN))


def _telling(match: F.Column) -> F.Column:
    return F.regexp_like(match, F.lit("[0-9]")) & F.regexp_like(match, F.lit("[a-z]")) & F.regexp_like(match, F.lit("[A-Z]"))


def _base(whole: F.Column) -> list[F.Column]:
    return [found(whole, ASSIGN, 0, lambda value: F.length(value) >= VALUE, 2, _named(whole)), found(whole, ACCESS, 1, may=F.contains(whole, F.lit("AKIA"))), found(whole, HEX, 2)]


def _parts(docs: DataFrame, doc_id: str, text: str, row: F.Column) -> DataFrame:
    """doc_id, row, base spans and weak candidates of each text. Only linkable texts have candidates to ask for."""
    whole = text_or_empty(text)
    weak = F.concat(found(whole, KEY, 3, _telling), found(whole, ENDPOINT, 4), found(whole, IDENT, 5))
    weak = F.when(linkable(whole), weak).otherwise(F.array().cast(SPAN))
    return docs.select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.array_sort(F.concat(*_base(whole))).alias("base"), weak.alias("weak"))


def _near(asking: DataFrame, parts: DataFrame, roles: dict[str, tuple[int, ...]]) -> DataFrame:
    """``asking`` (row, start, kind, end) with a flag per role: a part of its kinds lies within SCOPE of it."""

    def cell(place: F.Column) -> F.Column:
        return F.floor(place / SCOPE)

    spread = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    low = F.greatest(F.col("start").cast("long"), F.col("cell") * SCOPE)
    high = F.least(F.col("end").cast("long"), F.col("cell") * SCOPE + SCOPE - 1)
    ends = []
    for role, kinds in roles.items():
        ours = F.col("kind").isin(*kinds)
        ends += [F.min(F.when(ours, low)).alias(f"{role}_first"), F.max(F.when(ours, high)).alias(f"{role}_last")]
    cells = spread.groupBy("row", "cell").agg(*ends)
    wide = asking.withColumn("cell", F.explode(F.sequence(cell(F.col("start")) - 1, cell(F.col("end")) + 1)))
    met = wide.join(cells, ["row", "cell"])
    within = lambda place: F.col(place).between(F.col("start") - SCOPE, F.col("end") + SCOPE)
    flags = [F.max(F.coalesce(within(f"{role}_last") | within(f"{role}_first"), F.lit(False))).alias(role) for role in roles]
    return met.groupBy("row", "start", "kind", "end").agg(*flags)


def _linked(rows: DataFrame) -> DataFrame:
    """row and the weak spans that complementary parts confirm."""
    some = rows.where(F.size("weak") > 0)
    parts = stage(some.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.start", "s.kind", "s.end"), "secret-parts")
    weak = parts.where(F.col("kind") >= 3)
    by = stage(_near(weak, parts, {"access": (1,), "ident": (5,), "assigned": (0,), "hexed": (2,), "keyed": (3,)}), "secret-near")
    bridges = by.where("kind = 4 AND (access OR ident)").select("row", "start", "kind", "end")
    keys = by.where("kind = 3").select("row", "start", "kind", "end")
    bridged = _near(keys, bridges, {"endpoint": (4,)}).where("endpoint").select("row", "start", "kind", "end")
    direct = by.where("kind = 3 AND (access OR ident) OR kind = 4 AND (assigned OR access AND hexed OR (access OR ident) AND keyed) OR kind = 5 AND (assigned OR keyed)").select("row", "start", "kind", "end")
    return direct.union(bridged).distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def _scanned(parts: DataFrame) -> DataFrame:
    rows = stage(parts, "secret-rows")
    return rows.join(_linked(rows), "row", "left").select(
        "doc_id", "row", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans")
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans of each row: arrays of (start, kind, end), kind numbered as in KINDS."""
    return _scanned(_parts(docs, doc_id, text, F.monotonically_increasing_id())).select("doc_id", "base", "spans")


def spelled(spans: str) -> F.Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blanked(whole: F.Column, spans: F.Column, mark: str) -> F.Column:
    """``whole`` with its ``spans``, at least one, sorted by start, replaced; overlapping ones become one."""
    end = lambda at, s: F.greatest(at, s["end"])

    def pieces(at: F.Column, chunk: F.Column) -> F.Column:
        # places are sought in the chunk's own part of the text, as they are counted from its beginning each time
        part = F.substring(whole, at + 1, F.greatest(F.lit(0), F.element_at(chunk, -1)["start"] - at))

        def joined(part: F.Column) -> F.Column:
            start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

            def step(acc: F.Column, s: F.Column) -> F.Column:
                piece = F.concat(F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mark))
                out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
                return F.struct(end(acc["at"], s).alias("at"), out.alias("out"))

            return F.aggregate(chunk, start, step, lambda acc: acc["out"])

        return bound(part, joined)

    rest = F.substring(whole, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(whole))
    return F.concat(F.array_join(running(spans, F.lit(0), end, pieces), ""), rest)


def redact(docs: DataFrame, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one.

    Texts without spans stay as they are, null included. Only linkable texts can have linked spans, so only
    these are joined with them; all others are cleaned where they are read. ``docs`` has to give the same rows
    in the same order each time it is read, as a table does.
    """
    row, spans = fresh(docs, "row", "spans")
    whole = F.col(text)
    joins = F.coalesce(linkable(whole), F.lit(False))
    some = docs.where(joins).withColumn(row, F.monotonically_increasing_id())
    linked = _scanned(_parts(some, doc_id, text, F.col(row))).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans))
    alone = docs.where(~joins).withColumn(spans, F.array_sort(F.concat(*_base(text_or_empty(text)))))
    clean = F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, _blanked(whole, F.col(spans), mark)).otherwise(whole)
    put = lambda df: df.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
    return put(alone).union(put(some.join(linked, row, "left")))
