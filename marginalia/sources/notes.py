"""Notes of a vault: front matter, embeds, links, tags and class.

Embeds are joined, not searched for: targets meet files by path, name or stem with a priority, the notes
reachable from each note are found level by level, and only then each note's tree is written out, in
order, from its own small group.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.functions import text as tx

DEPTH = 4
#: What ``load_notes`` adds to a file.
NOTE_COLUMNS = {"frontmatter": "string", "frontmatter_tags": "array<string>", "inline_tags": "array<string>", "classification": "string"}
EMBED = r"!\[\[([^\]]+)\]\]"
# Suffixes of notes to write out and of attachments to name.
NOTE_SUFFIXES = (".md", ".txt")
ATTACHMENT_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".pdf", ".mp3", ".wav", ".m4a", ".mp4", ".mov")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _tidy(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` components."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != ".") & (p != ""))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def embeds(notes: DataFrame) -> DataFrame:
    """Distinct (path, target) of the embeds outside code in ``body``."""
    found = F.flatten(F.transform(md.segments("body"), lambda s: F.when(s["is_code"], F.array().cast("array<string>")).otherwise(F.regexp_extract_all(s["text"], F.lit(EMBED), F.lit(1)))))
    return notes.select("path", F.explode(F.array_distinct(found)).alias("target"))


def resolve(links: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """(path, target, found) of the links that meet a file.

    A target (cut at ``|`` and ``#``) with a suffix is looked for as it is; else with ``.md``, then as it is; each beside
    its note, under the root, then by name anywhere; at last a bare one as ``name.*``. Ties go to the smaller path.
    """
    name = tx.strip(F.substring_index(F.substring_index("target", "|", 1), "#", 1))
    last = F.element_at(F.split(name, "/"), -1)
    bare = ~F.rlike(last, F.lit(r"^.+\.[^.]+$"))
    asked = links.select("path", "target", name.alias("name"), bare.alias("bare")).where("name <> ''")
    tries = F.when(F.col("bare"), F.array(F.struct(F.lit(0).alias("p"), F.concat("name", F.lit(".md")).alias("n")), F.struct(F.lit(10).alias("p"), F.col("name").alias("n")))).otherwise(
        F.array(F.struct(F.lit(0).alias("p"), F.col("name").alias("n")))
    )
    asked = asked.withColumn("t", F.explode(tries))
    beside = F.struct((F.col("t.p") + 1).alias("p"), F.lit("path").alias("kind"), _tidy(F.concat(_folder(F.col("path")), F.lit("/"), F.col("t.n"))).alias("k"))
    under = F.struct((F.col("t.p") + 2).alias("p"), F.lit("path").alias("kind"), _tidy(F.concat(F.lit((root or "").rstrip("/") + "/"), F.col("t.n"))).alias("k"))
    named = F.struct((F.col("t.p") + 3).alias("p"), F.lit("name").alias("kind"), F.element_at(F.split("t.n", "/"), -1).alias("k"))
    stemmed = F.struct(F.lit(99).alias("p"), F.lit("stem").alias("kind"), F.element_at(F.split("name", "/"), -1).alias("k"))
    keys = F.when(F.col("bare"), F.array(beside, under, named, stemmed)).otherwise(F.array(beside, under, named))
    wanted = asked.select("path", "target", F.explode(keys).alias("w")).select("path", "target", "w.*").distinct()
    last_name = F.element_at(F.split("path", "/"), -1)
    known = files.select(F.col("path").alias("found"), F.explode(F.array(F.struct(F.lit("path").alias("kind"), F.col("path").alias("k")), F.struct(F.lit("name").alias("kind"), last_name.alias("k")), F.struct(F.lit("stem").alias("kind"), F.substring_index(last_name, ".", 1).alias("k")))).alias("w")).select("found", "w.*")
    # of files that share a name the first path stands for all, before the join
    known = known.groupBy("kind", "k").agg(F.min("found").alias("found"))
    met = wanted.join(known, ["kind", "k"])
    return met.groupBy("path", "target").agg(F.min_by("found", F.struct("p", "found")).alias("found"))


def write_out(root: str, bodies: dict[str, str | None], found: dict[tuple[str, str], str], depth: int = DEPTH) -> str:
    """The body of ``root`` with embeds written out, depth first; a note is written once in the whole text."""
    seen: set[str] = set()

    def expand(path: str, level: int) -> str:
        body = bodies[path] or ""
        if level >= depth:
            return body
        return "".join(part if code else re.sub(EMBED, lambda m: one(path, m[1], level), part) for part, code in fenced(body))

    def one(path: str, target: str, level: int) -> str:
        hit = found.get((path, target))
        if hit is None:
            return ""
        name = os.path.basename(hit)
        suffix = os.path.splitext(name)[1].lower()
        if suffix in ATTACHMENT_SUFFIXES:
            return f"\n[Embedded attachment: {name}]\n"
        if suffix not in NOTE_SUFFIXES:
            return f"\n[Embedded file (unsupported type): {name}]\n"
        if hit in seen:
            return ""
        seen.add(hit)
        if bodies.get(hit) is None:
            return f"\n[Embedded note unreadable: {name}]\n"
        return f"\n\n<!-- EMBED: {name} -->\n{expand(hit, level + 1)}\n<!-- /EMBED -->\n\n"

    return expand(root, 0)


def fenced(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of ``text`` and whether they are code; see functions.markdown.segments."""
    held, code = [], False
    for line in text.splitlines(keepends=True):
        held.append(line)
        if line.lstrip().startswith(md.FENCE):
            yield "".join(held), code
            held, code = [], not code
    if held:
        yield "".join(held), code


def expand_embeds(notes: DataFrame, vault: DataFrame, root: str | None = None, depth: int = DEPTH) -> DataFrame:
    """(path, text): bodies of ``notes`` (path, body) with embeds written out from ``vault`` (path, body or null).

    Paths are distinct on either side. A note may lie outside the vault; it can embed, but is not found by others.
    Only notes with embeds are gathered, each in a group about as large as its text will be; the others pass as they are.
    """
    embedding = F.coalesce(F.contains("body", F.lit("![[")), F.lit(False))
    plain = notes.where(~embedding).select("path", F.coalesce("body", F.lit("")).alias("text"))
    outside = notes.select("path", "body").join(vault.select("path"), "path", "left_anti")
    bodies = vault.select("path", "body").union(outside)
    links = resolve(embeds(bodies.where(embedding)), vault, root)
    reach = notes.where(embedding).select(F.col("path").alias("root"), "path")
    frontier = reach
    for _ in range(depth):
        frontier = frontier.join(links.select("path", "found"), "path").select("root", F.col("found").alias("path")).distinct()
        reach = reach.union(frontier)
    reach = reach.distinct()
    met = links.groupBy("path").agg(F.collect_list(F.struct("target", "found")).alias("links"))
    rows = reach.join(bodies, "path", "left").join(met, "path", "left")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bodies = dict(zip(frame["path"], frame["body"], strict=True))
        found = {(p, x["target"]): x["found"] for p, some in zip(frame["path"], frame["links"], strict=True) if some is not None for x in some}
        return pd.DataFrame({"path": [key[0]], "text": [write_out(key[0], bodies, found, depth)]})

    return rows.groupBy("root").applyInPandas(run, "path string, text string").union(plain)


def load_notes(read: DataFrame, vault: DataFrame, root: str | None = None, depth: int = DEPTH) -> DataFrame:
    """``read`` (path, size, mtime, error, raw) as notes: text, frontmatter (JSON), tags and class.

    In order: front matter off, embeds written out, links stripped outside code, inline tags taken.
    """
    def split(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", md.front_matter("raw")).select("path", F.when(F.col("raw").isNotNull(), F.col("_f.body")).alias("body"), F.col("_f.source").alias("source"))

    parts = split(read)
    texts = expand_embeds(parts.where("body IS NOT NULL"), split(vault), root, depth)
    meta = parts.select("path", "body", md.front_matter_json("source").alias("frontmatter"))
    whole = read.select("path", "size", "mtime", "error").join(meta, "path").join(texts, "path", "left")
    tags = md.normalize_tags(F.get_json_object("frontmatter", "$.tags"))
    name = F.element_at(F.split("path", "/"), -1)
    return (
        whole.withColumn("text", F.when(F.col("body").isNotNull(), md.strip_links(F.coalesce("text", "body"))))
        .withColumn("frontmatter_tags", tags)
        .withColumn("inline_tags", md.inline_tags("text"))
        .withColumn("classification", md.classify(name, F.get_json_object("frontmatter", "$.type"), "frontmatter_tags"))
        .drop("body")
    )


def legacy_notes(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` files below ``root`` under the older rules: bad bytes dropped, tags sorted, embeds and links kept."""
    from .files import extension, list_files, read_bytes

    if "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(f"no such vault: {root}")

    def forgiving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if b is None else b.decode("utf-8", "ignore") for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "_t"])

    read = read_bytes(list_files(spark, [root]).where(extension("path") == ".md"), 1 << 31)
    front = read.select("path", "content").mapInArrow(forgiving, "path string, _t string").withColumn("_f", md.front_matter("_t", legacy=True))
    tagged = front.withColumn("_tags", md.normalize_tags(F.get_json_object(md.front_matter_json("_f.source", legacy=True), "$.tags"), legacy=True))
    name = F.element_at(F.split("path", "/"), -1)
    return tagged.select(
        F.col("path").alias("source_path"), md.path_features("path").alias("_p"), name.alias("file_name"), F.col("_f.body").alias("text"),
        F.array_join("_tags", ", ").alias("frontmatter_tags"), F.array_join(md.inline_tags("_f.body", legacy=True), ", ").alias("inline_tags"), md.classify(name, None, "_tags", legacy=True).alias("classification"),
    ).select("source_path", "_p.*", "file_name", "text", "frontmatter_tags", "inline_tags", "classification")
