"""Header-aware chunks of whole tables, held against cuts by position."""

import re

import pyarrow.parquet as pq

from marginalia import registry
from marginalia.operators import chunk

D = "/root/testdata/sf0.001"


def sections(text):
    """(shallowest heading in force, body) by a walk over line numbers."""
    lines = text.split("\n")
    code, marks = False, []
    for n, line in enumerate(lines):
        if not code and (m := re.fullmatch(r"(#{1,6})[ \t]+(\S.*?)\s*", line)):
            marks.append((n, len(m[1]), f"{m[1]} {m[2]}"))
        elif line.lstrip().startswith("```"):
            code = not code
    for i, lo in enumerate([-1, *(m[0] for m in marks)]):
        hi = marks[i][0] if i < len(marks) else len(lines)
        in_force = [(level, name) for k, (_, level, name) in enumerate(marks[:i]) if all(later > level for _, later, _ in marks[k + 1 : i])]
        yield (min(in_force)[1] if in_force else None), "\n".join(lines[lo + 1 : hi])


def spans(text, lo, hi, size, separators):
    """Cuts of text[lo:hi] as positions."""
    if hi - lo <= size:
        return [(lo, hi)]
    if not separators:
        return [(a, min(a + size, hi)) for a in range(lo, hi, size)]
    sep, *rest = separators
    cuts = [lo]
    at = text.find(sep, lo, hi)
    while at >= 0:
        cuts.append(at)
        at = text.find(sep, at + len(sep), hi)
    cuts = sorted({*cuts, hi})
    return [s for a, b in zip(cuts, cuts[1:], strict=False) for s in spans(text, a, b, size, rest)]


def pieces(text, size, overlap):
    cut = spans(text, 0, len(text), size, ["\n\n", "\n", " "])
    first, found = 0, []
    for n, (_, end) in enumerate(cut):
        if n > first and end - cut[first][0] > size:
            found.append((cut[first][0], cut[n][0]))
            while first < n and (cut[n][0] - cut[first][0] > overlap or end - cut[first][0] > size):
                first += 1
    found.append((cut[first][0], cut[-1][1]))
    return [t for a, b in found if (t := text[a:b].strip())]


def brute(text, size=chunk.SIZE, overlap=200):
    return [(head, i, len(some), t) for head, body in sections(text) if body.strip() for some in [pieces(body.strip(), size, overlap)] for i, t in enumerate(some)]


def test_query_against_positions(spark):
    docs = pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    want = sorted((str(r["doc_id"]), *map(str, c)) for r in docs for c in brute(f"# Top\n{r['text']}\n## {r['source']}\n{r['text']}"))
    got = registry.QUERIES["chunk_by_headers"](spark, D).collect()
    assert sorted((r.doc_id, str(r.section_heading), str(r.chunk_idx), str(r.chunk_total), r.text) for r in got) == want


def test_notation_against_positions(spark):
    word = lambda n: " ".join(f"word{i}" for i in range(n))
    texts = [None, "", " \n", "x" * 3000, word(900), f"## a\n{word(200)}\n\n{word(300)}\n# b\nlead\n```\n# no\n```\n### c\n\n\n{word(10)}\n{'y' * 1300} z\n#bad\n## d", "\n\n".join(word(n) for n in range(1, 60)), "\n".join("é" * n for n in range(0, 90))]
    rows = chunk.by_headers(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 400, 90).collect()
    want = sorted((str(i), *map(str, c)) for i, t in enumerate(texts) for c in brute(t or "", 400, 90))
    assert sorted((r.doc_id, str(r.section_heading), str(r.chunk_idx), str(r.chunk_total), r.text) for r in rows) == want
