"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that str.strip and str.split know, as text and as a class of Java patterns.
WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
WS_INSIDE = "".join(f"\\u{lo:04X}" if lo == hi else f"\\u{lo:04X}-\\u{hi:04X}" for lo, hi in WS_RANGES)
WS_CLASS = f"[{WS_INSIDE}]"

# Phrases by which an answer admits that it has no evidence.
ABSTENTIONS = ("i don't know", "i do not know", "not enough information", "cannot determine", "no information")

SIGNATURE_CHARS, QUOTE_CHARS, SENTENCE_CHARS = 500, 240, 260


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at both ends, all 29 code points of it."""
    return F.btrim(_col(text), F.lit(WS))


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


def token_estimate(text: Column | str) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("int"))


def signature(text: Column | str) -> Column:
    """Lower case, white space runs as one space, the first 500 characters."""
    return F.substring(strip(F.regexp_replace(F.lower(_col(text)), f"{WS_CLASS}+", " ")), 1, SIGNATURE_CHARS)


def quote(text: Column | str, n: int = QUOTE_CHARS) -> Column:
    return F.substring(_col(text), 1, n)


def terms(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters, digits, ``_``, ``/`` and ``-``."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit("([A-Za-z0-9_/-]+)"), F.lit(1)), F.lower)


def sentences(text: Column | str) -> Column:
    return F.split(_col(text), f"(?<=[.!?]){WS_CLASS}+", -1)


def best_sentence(query: Column | str, text: Column | str, max_len: int = SENTENCE_CHARS) -> Column:
    """The first sentence with the most distinct terms of the query; longer ones are cut to end in an ellipsis."""
    wanted = F.array_distinct(terms(query))
    scored = F.transform(sentences(text), lambda s, i: F.struct(-F.size(F.array_intersect(terms(s), wanted)), i, strip(s).alias("s")))
    best = F.array_min(scored)["s"]
    return F.when(F.length(best) > max_len, F.concat(F.substring(best, 1, max_len - 1), F.lit("…"))).otherwise(best)


def abstained(text: Column | str) -> Column:
    """Whether an answer admits lack of evidence."""
    low = F.lower(_col(text))
    found = F.lit(False)
    for phrase in ABSTENTIONS:
        found = found | F.contains(low, F.lit(phrase))
    return found


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def doc_id(uri: Column | str, text_hash: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", _col(uri), _col(text_hash)), 256)


def chunk_id(doc: Column | str, strategy: str, index: Column | str, start: Column | str, end: Column | str) -> Column:
    as_text = [_col(x).cast("string") for x in (doc, index, start, end)]
    return F.concat(as_text[0], F.lit(f":{strategy}:"), as_text[1], F.lit(":"), as_text[2], F.lit("-"), as_text[3])


def cache_key(model: str, text: Column | str, dim: int | None = None) -> Column:
    """Key of an embedding. With ``dim`` a change of dimension does not reuse old vectors."""
    name = model if dim is None else f"{model}#{dim}"
    return F.sha2(F.concat(F.lit(f"{name}|"), F.sha2(_col(text), 256)), 256)
