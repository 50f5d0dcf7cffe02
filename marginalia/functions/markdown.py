"""Markdown notes as Column expressions: front matter, tags, fences, links, headings, classes.

Two generations of rules exist; ``legacy`` picks the older one.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, WS_CLASS, WS_INSIDE, _col, strip

TAG = r"(?U)(?<!\w)#([A-Za-z0-9/_-]+)"
LEGACY_TAG = r"(?U)(?<!\w)#([\w/-]+)"
FENCE = "```"
#: An opened and closed link: its alias if that has more than white space, else its target.
LINK = rf"\[\[(?!\]\])(?:{WS_CLASS}*([^\]|]*?){WS_CLASS}*\|{WS_CLASS}*|[^\]|]*\|{WS_CLASS}*([^\]]*?[^\]{WS_INSIDE}]){WS_CLASS}*|{WS_CLASS}*([^\]|]*?){WS_CLASS}*)\]\]"
#: Where a line ends: after every line end that Unicode knows.
ENDS = r"\n\x0b\x0c\x1c-\x1e\u0085\u2028\u2029"
ONE_END = rf"(?:\r\n|[\r{ENDS}])"
#: Lines that do not begin with a fence and then one that does, or the rest. Its outer loop gives nothing back, so that long texts need no deep stack.
OPENS = rf"[{WS_INSIDE}&&[^\r{ENDS}]]*+{FENCE}"
SEGMENT = rf"(?:(?!{OPENS})[^\r{ENDS}]*+{ONE_END})*+{OPENS}[^\r{ENDS}]*+{ONE_END}?|[\s\S]+"
#: From an opening ``---`` to the next line that is ``---`` but for white space, where line ends are line feeds. Group 1 is what lies between.
EDGE = rf"[{WS_INSIDE}&&[^\n]]*+"
FRONT = rf"\A(?=[^\n]*+\n[^\n]*+\n)---[^\n]*+\n([\s\S]*?)(?<=\n){EDGE}---{EDGE}(?:\n|\z)"
LEGACY_FRONT = rf"\A{EDGE}---{EDGE}\n([\s\S]*?)(?<=\n){EDGE}---{EDGE}(?:\n|\z)"


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of ``value``, which is worked out once however often ``build`` names it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _line_feeds(text: Column, ends: str) -> Column:
    """``text`` with line feeds for its line ends. Plain replacements run faster than a pattern, and leave most texts as they are."""
    for end in ("\r\n", *ends):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return text


def front_matter(text: Column | str, legacy: bool = False) -> Column:
    """Struct of the front matter's source (null: none) and the body.

    New: any text that begins with ``---``, at least 3 lines; lines end where Unicode says, are joined by line
    feeds, and a final one is lost. Legacy: byte order marks go, line ends become line feeds, the first line has
    to be ``---`` alone, and the body's leading line feeds go. Null stays null. Texts that a Python function made have to come
    through ``mapInArrow`` or a written table: Spark puts no Python function into a lambda.
    """
    whole = _col(text)
    if legacy:
        whole = _line_feeds(F.ltrim(whole, F.lit("\ufeff")), "\r")
        plain, pattern = whole, LEGACY_FRONT
    else:
        lines = _line_feeds(whole, "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
        lines = _once(lines, lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t))
        plain, pattern = F.when(F.startswith(whole, F.lit("---")), lines).otherwise(F.lit("")), FRONT

    def parts(t: Column) -> Column:
        def cut(head: Column) -> Column:
            body = F.substring(t, F.length(head) + 1, F.length(t))
            found = F.struct(strip(F.regexp_extract(head, pattern, 1)).alias("source"), (F.ltrim(body, F.lit("\n")) if legacy else body).alias("body"))
            return F.when(head != "", found).otherwise(F.struct(F.lit(None).cast("string").alias("source"), whole.alias("body")))

        return _once(F.regexp_extract(t, pattern, 0), cut)

    return _once(plain, parts)


def parse_front_matter(source: str | None, legacy: bool = False) -> dict:
    """Keys and values of a front matter. Where YAML fails: none (legacy), or ``key: value`` lines and flat lists."""
    if not source:
        return {}
    try:
        import yaml

        loaded = yaml.load(source, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return loaded if isinstance(loaded, dict) else {}
    except Exception:
        return {} if legacy else _plain_pairs(source)


#: A line of a front matter that is no YAML: a key, and a flat list or the rest of the line.
PAIR = re.compile(r"\s*([^\s:](?:[^:]*[^\s:])?)\s*:\s*(?:\[(?P<items>.*)\]|(?P<value>.*?))\s*")


def _plain_pairs(source: str) -> dict:
    """The ``key: value`` lines; quotes around values and list items go, blank items too."""
    found = filter(None, map(PAIR.fullmatch, source.splitlines()))
    bare = lambda x: x.strip().strip("'\"")
    return {m[1]: bare(m["value"]) if m["items"] is None else [bare(x) for x in re.findall(r"[^,]*[^,\s][^,]*", m["items"])] for m in found}


def front_matter_json(source: Column | str, legacy: bool = False) -> Column:
    """The parsed front matter as JSON text; values that JSON lacks, such as dates, as text."""

    @F.pandas_udf("string")
    def parse(column: pd.Series) -> pd.Series:
        return column.map(lambda s: json.dumps(parse_front_matter(s, legacy), default=str, ensure_ascii=False))

    return parse(_col(source))


def normalize_tags(value: Column | str, legacy: bool = False) -> Column:
    """Tags of a JSON value: a list's texts stripped, or a text cut at commas (legacy: not cut, blanks of lists kept)."""
    v = _col(value)
    listed = F.from_json(v, "array<string>")
    items = F.transform(F.filter(listed, lambda x: x.isNotNull()), strip)
    is_list = F.startswith(strip(v), F.lit("["))
    if legacy:
        return F.when(v.isNull(), F.array().cast("array<string>")).when(is_list, items).otherwise(F.array(strip(v)))
    cut = F.transform(F.split(v, ",", -1), strip)
    return F.filter(F.when(v.isNull(), F.array().cast("array<string>")).when(is_list, items).otherwise(cut), lambda x: x != "")


def inline_tags(text: Column | str, legacy: bool = False) -> Column:
    """Distinct ``#tags``, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(LEGACY_TAG if legacy else TAG), F.lit(1))))


def segments(text: Column | str) -> Column:
    """The text cut at code fences: array of (text, is_code) in order.

    A line that begins with a fence, white space aside, changes sides after itself: the opening line
    belongs to the text, the closing one to the code. Unclosed code reaches to the end.
    """
    parts = F.regexp_extract_all(_col(text), F.lit(SEGMENT), F.lit(0))
    return F.transform(parts, lambda part, i: F.struct(part.alias("text"), (i % 2 == 1).alias("is_code")))


def strip_links(text: Column | str) -> Column:
    """``[[target|alias]]`` outside code becomes its alias, or its target where that is blank."""
    return F.array_join(F.transform(segments(text), lambda s: F.when(s["is_code"], s["text"]).otherwise(F.regexp_replace(s["text"], LINK, "$1$2$3"))), "")


def sections(text: Column | str, min_level: int = 2) -> Column:
    """The text cut at headings of ``min_level`` or deeper: array of (heading, body).

    Without such a heading it is one section, as it is; else the text before the first is a section where it
    is not blank. Higher headings stay in the bodies. Fences do not count here; the characters 1 and 2 go.
    """
    whole = F.replace(F.replace(_line_feeds(_col(text), "\r"), F.lit("\x01"), F.lit("")), F.lit("\x02"), F.lit(""))
    higher = f"#{{1,{min_level - 1}}}" if min_level > 1 else "(?!)#"
    pattern = rf"(?md)^(?:(#{{{min_level},6}}{WS_CLASS}+.+?){WS_CLASS}*$|({higher}{WS_CLASS}+.+?{WS_CLASS}*$))"
    none = F.lit(None).cast("string")
    section = lambda heading, body: F.struct(heading.alias("heading"), body.alias("body"))

    def cut(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: section(strip(F.substring_index(p, "\x02", 1)), strip(F.substring_index(p, "\x02", -1))))
        before = F.filter(F.array(section(none, strip(F.element_at(parts, 1)))), lambda s: s["body"] != "")
        return F.when(F.size(parts) == 1, F.array(section(none, F.element_at(parts, 1)))).otherwise(F.concat(before, rest))

    marked = F.replace(F.regexp_replace(whole, pattern, "\x01$1\x02$2"), F.lit("\x01\x02"), F.lit(""))
    return _once(F.split(marked, "\x01", -1), cut)


def classify(file_name: Column | str, kind: Column | str | None, tags: Column | str, legacy: bool = False) -> Column:
    """"moc" if the name holds it in any case, or the type or a tag is it (legacy: in this case, tags alone)."""
    said = F.exists(_col(tags), lambda t: (t if legacy else F.lower(t)) == "moc")
    if kind is not None and not legacy:
        said = said | F.coalesce(F.lower(_col(kind)) == "moc", F.lit(False))
    return F.when(F.contains(F.lower(_col(file_name)), F.lit("moc")) | said, "moc").otherwise("note")


def path_features(path: Column | str) -> Column:
    """root_dir, relative_dir and is_ai of a path: from its first component ``AI`` on, or its parent."""
    parts = F.split(_col(path), "/", -1)
    dirs = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    at = F.array_position(parts, "AI").cast("int")
    parent = F.coalesce(F.get(dirs, F.size(dirs) - 1), F.lit(""))
    inside = F.array_join(F.slice(dirs, F.greatest(F.lit(1), at), F.greatest(F.lit(0), F.size(dirs))), "/")
    return F.struct(
        F.when(at > 0, "AI").otherwise(parent).alias("root_dir"),
        F.when(at > 0, inside).otherwise(parent).alias("relative_dir"),
        (at > 0).alias("is_ai"),
    )


def note_sections(notes: DataFrame, text: str = "text", min_level: int = 2) -> DataFrame:
    """A row per section of each note that is not blank, with section_heading, body and its legacy inline tags."""
    cut = notes.withColumn("_s", F.explode(sections(text, min_level)))
    return cut.where(strip("_s.body") != "").select(*notes.columns, F.col("_s.heading").alias("section_heading"), F.col("_s.body").alias("section_text"), F.array_join(inline_tags("_s.body", legacy=True), ", ").alias("section_tags"))


def header_chunks(text: str, size: int = 1200, overlap: int = 200) -> Iterator[dict]:
    """Sections by every heading level, each cut by paragraphs, lines, words, then characters.

    Our own reading of the two third-party splitters: a section ends at the next heading outside a fence;
    its heading is the shallowest one in force; pieces are merged up to ``size`` characters, and each
    but the first begins with up to ``overlap`` characters of whole pieces from the one before.
    """
    for heading, body in _by_header(text):
        if body.strip():
            pieces = list(_merge(_pieces(body.strip(), size, ("\n\n", "\n", " ", "")), size, overlap))
            for i, piece in enumerate(pieces):
                yield {"section_heading": heading, "text": piece, "chunk_idx": i, "chunk_total": len(pieces)}


def _by_header(text: str) -> Iterator[tuple[str | None, str]]:
    heads: dict[int, str] = {}
    body: list[str] = []
    fenced = False
    for line in text.split("\n"):
        found = None if fenced else re.match(r"(#{1,6})[ \t]+(.*\S)", line)
        if found:
            yield (heads[min(heads)] if heads else None), "\n".join(body)
            level = len(found[1])
            heads = {k: v for k, v in heads.items() if k < level} | {level: f"{found[1]} {found[2]}"}
            body = []
        else:
            fenced ^= line.lstrip().startswith(FENCE)
            body.append(line)
    yield (heads[min(heads)] if heads else None), "\n".join(body)


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that does, which stays in front of the next."""
    if len(text) <= size:
        yield text
        return
    first, *rest = separators
    if not first:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    for i, part in enumerate(text.split(first)):
        if piece := (first if i else "") + part:
            yield from _pieces(piece, size, tuple(rest))


def _merge(pieces: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if done := "".join(held).strip():
                yield done
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if done := "".join(held).strip():
        yield done
