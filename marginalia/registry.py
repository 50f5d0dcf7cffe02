"""Queries over the driver's tables, one or more per operator, and their SQL for another engine.

The tables hold no notes, so queries on markdown write notation around the texts by rule, in both
engines alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.functions import text as tx
from marginalia.operators import cells, chunk, context, embed, evaluate, search, select
from marginalia.plans import explore, rag, tables
from marginalia.plans.config import load_profile
from marginalia.plans.staging import delete, new_path, stage
from marginalia.sources import files, listing, notes, store
from marginalia.sources.versions import VersionedTable
from marginalia.streaming import sync

QUERIES, ORACLES = {}, {}
SQL_WS = "(" + " || ".join(f"chr({c})" for c in map(ord, tx.WS)) + ")"
RE_WS = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in tx.WS_RANGES) + "]"
QUESTION = "the retrieval of en la is quality"
SHARES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CHUNKS_SQL = f"""
w AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, unnest(range(0, length(text), 1050)) AS s FROM documents WHERE trim(text, {SQL_WS}) <> ''),
c AS (SELECT doc_id, CAST(s AS INT) AS start_char, CAST(least(length(text), s + 1200) AS INT) AS end_char, trim(substr(text, s + 1, 1200), {SQL_WS}) AS text FROM w),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS INT) AS chunk_index FROM c WHERE text <> '')
"""
CHUNK_ID_SQL = "doc_id || ':fixed:' || chunk_index || ':' || start_char || '-' || end_char"


@query(f"WITH {CHUNKS_SQL} SELECT {CHUNK_ID_SQL} AS chunk_id, doc_id, chunk_index, start_char, end_char, text FROM chunks")
def chunk_fixed(spark, d):
    return chunk.fixed(table(spark, d, "documents"))


@query()
def chunk_by_headers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# Top\n"), "text", F.lit("\n## "), "source", F.lit("\n"), "text").alias("text"))
    return chunk.by_headers(docs)


@query(
    """SELECT doc_id AS id, sha256(text) AS content_hash, sha256('file:' || source || '|' || sha256(text)) AS stable_id, sha256('m|' || sha256(text)) AS key
    FROM documents"""
)
def doc_identity(spark, d):
    uri = F.concat(F.lit("file:"), "source")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.content_hash("text").alias("content_hash"), tx.doc_id(uri, tx.content_hash("text")).alias("stable_id"), tx.cache_key("m", "text").alias("key"))


@query("SELECT doc_id, CAST(i AS INT) AS i, round(CAST('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2) AS INT) / 127.5 - 1.0, 9) AS value FROM documents, range(0, 128) t(i)")
def embed_dummy(spark, d):
    rows = embed.dummy(table(spark, d, "documents"))
    return rows.select("doc_id", F.posexplode("vector").alias("i", "v")).select("doc_id", "i", F.round("v", 9).alias("value"))


@query(
    """WITH k AS (SELECT doc_id, sha256('m|' || sha256(text)) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)
    SELECT k.doc_id, key, c.key IS NOT NULL AS was_cached FROM k LEFT JOIN c USING (key)"""
)
def embed_cached(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = embed.dummy(docs.where("doc_id % 2 = 0")).select(tx.cache_key("m", "text").alias("key"), F.lit("m").alias("model"), "vector").dropDuplicates(["key"])
    rows, fresh = embed.cached(docs, old, embed.dummy, "m")
    made = rows.where("vector IS NOT NULL").select("doc_id", tx.cache_key("m", "text").alias("key"))
    return made.join(fresh.select("key", F.lit(True).alias("new")), "key", "left").select("doc_id", "key", F.col("new").isNull().alias("was_cached"))


VECTORS_SQL = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, 'src' || label AS source_path, vec_id % 3 <> 0 AS is_ai, CASE WHEN vec_id % 7 = 0 THEN 'moc' ELSE 'note' END AS classification FROM embeddings)"
ALL_SCORES_SQL = f"{VECTORS_SQL}, s AS (SELECT q.vec_id AS qid, v.*, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0)"


def nodes(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        "vec_id", v.alias("vector"), "label", F.concat(F.lit("src"), F.col("label").cast("string")).alias("source_path"), (F.col("vec_id") % 3 != 0).alias("is_ai"), F.when(F.col("vec_id") % 7 == 0, "moc").otherwise("note").alias("classification")
    )


def asked(rows):
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("vector").alias("query_vector"))


def batch(spark, d, k):
    rows = nodes(spark, d)
    return search.search_all(rows, asked(rows), k, "vec_id")


@query(f"WITH {VECTORS_SQL} SELECT v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.vec_id = 0 ORDER BY score DESC, v.vec_id LIMIT 10")
def knn_single(spark, d):
    rows = nodes(spark, d)
    q = rows.where("vec_id = 0").first()["vector"]
    return search.search(rows, q, 10, ties=("vec_id",)).select("vec_id", "score")


@query(f"WITH {VECTORS_SQL} SELECT v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.vec_id = 0 AND v.classification = 'note' AND v.is_ai ORDER BY score DESC, v.vec_id LIMIT 10")
def knn_filtered(spark, d):
    rows = nodes(spark, d)
    q = rows.where("vec_id = 0").first()["vector"]
    return search.search(rows, q, 10, {"classification": "note", "is_ai": True}, ties=("vec_id",)).select("vec_id", "label", "score")


@query(f"WITH {ALL_SCORES_SQL} SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def knn_batch(spark, d):
    return batch(spark, d, 10)


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 30)
    SELECT qid, vec_id, source_path, score FROM t QUALIFY row_number() OVER (PARTITION BY qid, source_path ORDER BY score DESC, vec_id) = 1"""
)
def dedupe_source(spark, d):
    found = batch(spark, d, 30).join(nodes(spark, d).select("vec_id", "source_path"), "vec_id")
    return select.dedupe_by_source(found, node_id="vec_id", ties=("vec_id",)).select("qid", "vec_id", "source_path", "score")


def mmr_sql(candidates: str, k: int, lam: float) -> str:
    """CTEs from ``candidates`` (qid, vec_id, score, e of the query as q, e): ``mmr`` (qid, vec_id, mmr_rank)."""
    return f"""c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS o FROM ({candidates})),
    m AS (SELECT a.qid, a.o, any_value(a.vec_id) AS vec_id, any_value(list_cosine_similarity(a.q, a.e)) AS rel, list(list_cosine_similarity(a.e, b.e) ORDER BY b.o) AS likes FROM c a JOIN c b USING (qid) GROUP BY a.qid, a.o),
    picks AS (
      SELECT qid, 0 AS n, CAST([] AS BIGINT[]) AS picked FROM m GROUP BY qid
      UNION ALL
      SELECT p.qid, p.n + 1, list_append(p.picked, first(m.o ORDER BY round({lam} * rel - {round(1 - lam, 9)} * coalesce(list_max(list_transform(p.picked, lambda i: likes[i])), 0), 6) DESC, m.o))
      FROM picks p JOIN m ON m.qid = p.qid AND NOT list_contains(p.picked, m.o) WHERE p.n < {k} GROUP BY p.qid, p.n, p.picked
    ),
    longest AS (SELECT qid, arg_max(picked, n) AS picked FROM picks GROUP BY qid),
    mmr AS (SELECT l.qid, m.vec_id, CAST(list_position(l.picked, m.o) AS INT) AS mmr_rank FROM longest l JOIN m ON m.qid = l.qid AND list_contains(l.picked, m.o))"""


@query(
    f"""WITH RECURSIVE {ALL_SCORES_SQL}, {mmr_sql("SELECT s.qid, s.vec_id, q.e AS q, s.e FROM s JOIN v q ON q.vec_id = s.qid QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, s.vec_id) <= 20", 10, 0.65)}
    SELECT qid, vec_id, mmr_rank FROM mmr"""
)
def mmr(spark, d):
    rows = nodes(spark, d)
    found = batch(spark, d, 20).join(rows.select("vec_id", "vector"), "vec_id").join(asked(rows), "qid")
    return select.mmr(found, 10, 0.65, node_id="vec_id")


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS ord FROM s QUALIFY ord <= 10)
    SELECT qid, vec_id, CASE ord WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rerank_rank FROM t WHERE ord IN (1, 4, 3)"""
)
def rerank_apply(spark, d):
    rows = select.ranked(batch(spark, d, 10), ties=("vec_id",))
    replies = rows.select("qid").distinct().withColumn("reply", F.lit('Sure: {"ranked": [3, "0", 3, 99, true, 2, 1]} ok'))
    return select.apply_rerank(rows, replies, 3).select("qid", "vec_id", "rerank_rank")


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT * FROM s WHERE is_ai AND classification = 'note' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 30),
    u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid, source_path ORDER BY score DESC, vec_id) = 1)
    SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS ord FROM u QUALIFY ord <= 5"""
)
def profile_code(spark, d):
    rows = nodes(spark, d)
    _, final = rag.by_profile(rows, asked(rows), load_profile("code"), node_id="vec_id")
    return final.select("qid", "vec_id", "score", "ord")


@query(
    f"""WITH RECURSIVE {ALL_SCORES_SQL}, t AS (SELECT * FROM s WHERE classification = 'note' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 60),
    u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid, source_path ORDER BY score DESC, vec_id) = 1),
    {mmr_sql("SELECT u.qid, u.vec_id, q.e AS q, u.e FROM u JOIN v q ON q.vec_id = u.qid", 60, 0.65)}
    SELECT qid, vec_id, score, mmr_rank AS ord FROM mmr JOIN u USING (qid, vec_id) WHERE mmr_rank <= 6"""
)
def profile_reflection(spark, d):
    rows = nodes(spark, d)
    _, final = rag.by_profile(rows, asked(rows), load_profile("reflection"), node_id="vec_id")
    return final.select("qid", "vec_id", "score", "ord")


SIGNATURE_SQL = f"substr(trim(regexp_replace(lower(text), '{RE_WS}+', ' ', 'g'), {SQL_WS}), 1, 500)"
PACK_SQL = f"""
c AS (SELECT doc_id % 10 AS qid, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, text, source AS uri, round((doc_id * 37 % 101) / 101, 6) AS score, doc_id AS n FROM documents),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, {SIGNATURE_SQL} ORDER BY score DESC, n) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, n) AS INT) AS rank FROM u),
k AS (SELECT *, CAST(greatest(1, length('[' || rank || ']' || chr(10)) // 4) + greatest(1, length(text) // 4) + 1 AS BIGINT) AS cost FROM r),
p AS (SELECT *, CAST(2 + sum(cost) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM k QUALIFY used <= 1800 AND rank <= 10)
"""


def packed(spark, d):
    rows = table(spark, d, "documents").select(
        (F.col("doc_id") % 10).alias("qid"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("uri"), F.round((F.col("doc_id") * 37 % 101) / 101, 6).alias("score"), F.col("doc_id").alias("n")
    )
    return context.pack(rows, 1800, 10, ties=("n",))


@query(f"WITH {PACK_SQL} SELECT qid, chunk_id, rank, score, cost, used FROM p")
def context_pack(spark, d):
    return packed(spark, d).select("qid", "chunk_id", "rank", "score", F.col("cost").cast("long").alias("cost"), "used")


@query(f"WITH {PACK_SQL} SELECT qid, chunk_id, rank, score, cost, used FROM p")
def pack_in_sql(spark, d):
    """The same as context_pack, by a table function called from SQL."""
    tables.register(spark)
    rows = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("qid"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.round((F.col("doc_id") * 37 % 101) / 101, 6).alias("score"), F.col("doc_id").alias("n"))
    rows.createOrReplaceTempView("pack_in_sql_rows")
    return spark.sql("SELECT qid, chunk_id, rank, score, cost, used FROM pack_context(TABLE(pack_in_sql_rows) PARTITION BY qid ORDER BY (score DESC, n), budget => 1800, max_chunks => 10)")


@query(f"WITH {PACK_SQL} SELECT qid, rank, chunk_id, doc_id, uri, substr(text, 1, 240) AS quote, score FROM p")
def citations(spark, d):
    return context.citations(packed(spark, d))


RENDERED_HEAD_SQL = "'" + ("\n".join(context.RENDER_HEAD) + "\n").replace("'", "''") + "'"


@query(
    f"""WITH {PACK_SQL} SELECT qid, trim({RENDERED_HEAD_SQL} || string_agg('[' || rank || ']' || chr(10) || 'Source:  ' || uri || chr(10) || trim(text, {SQL_WS}) || chr(10), chr(10) ORDER BY rank), {SQL_WS}) || chr(10) AS rendered_context,
    max(used) AS tokens_used_est FROM p GROUP BY qid"""
)
def render_context(spark, d):
    return context.render(packed(spark, d))


def _digest_sql(text: str) -> str:
    return f"list_transform(range(0, 128), lambda i: CAST('0x' || substr(sha256({text}), CAST(i % 32 * 2 + 1 AS BIGINT), 2) AS INT) / 127.5 - 1.0)"


@query(
    f"""WITH {CHUNKS_SQL}, x AS (SELECT {CHUNK_ID_SQL} AS chunk_id, text, {_digest_sql("text")} AS e FROM chunks),
    q AS (SELECT item_id AS qid, text AS query, {_digest_sql("text")} AS e FROM benchmark),
    s AS (SELECT qid, chunk_id, x.text, round(list_cosine_similarity(q.e, x.e), 6) AS score FROM q, x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 10),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, {SIGNATURE_SQL} ORDER BY score DESC, chunk_id) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM u),
    k AS (SELECT *, greatest(1, length('[' || rank || ']' || chr(10)) // 4) + greatest(1, length(text) // 4) + 1 AS cost FROM r),
    p AS (SELECT *, 2 + sum(cost) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM k QUALIFY used <= 1800 AND rank <= 10),
    body AS (SELECT qid, trim(chr(10) || string_agg('[' || rank || ']' || chr(10) || trim(text, {SQL_WS}) || chr(10), chr(10) ORDER BY rank), {SQL_WS}) || chr(10) AS t FROM p GROUP BY qid),
    told AS (SELECT qid, query, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS wanted, regexp_replace(coalesce(t, ''), '([.!?]){RE_WS}+', '\\1' || chr(1), 'g') AS t FROM q LEFT JOIN body USING (qid)),
    cut AS (SELECT qid, query, wanted, unnest(string_split(t, chr(1))) AS one, generate_subscripts(string_split(t, chr(1)), 1) AS n FROM told),
    best AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(one), '[a-z0-9]+')), wanted)) AS hits FROM cut QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, n) = 1),
    a AS (SELECT qid, query, CASE WHEN hits > 0 THEN trim(one, {SQL_WS}) ELSE 'I don''t know.' END AS answer FROM best)
    SELECT qid, query, answer, {" OR ".join(f"contains(lower(answer), '{p.replace(chr(39), chr(39) * 2)}')" for p in tx.ABSTENTIONS)} AS abstained FROM a"""
)
def rag_answers(spark, d):
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return rag.rag_answer(stage(rag.index(table(spark, d, "documents")), "index"), questions)


@query(
    f"""SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens, substr(text, 1, 240) AS quote, {SIGNATURE_SQL} AS signature,
    list_transform(regexp_extract_all(text, '[A-Za-z0-9_/-]+'), lambda x: lower(x)) AS terms FROM documents"""
)
def text_scalars(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate("text").alias("tokens"), tx.quote("text").alias("quote"), tx.signature("text").alias("signature"), tx.terms("text").alias("terms"))


@query(
    f"""WITH q AS (SELECT list_distinct(list_transform(regexp_extract_all('{QUESTION}', '[A-Za-z0-9_/-]+'), lambda x: lower(x))) AS t),
    s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){RE_WS}+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?]){RE_WS}+', '\\1' || chr(1), 'g'), chr(1)), 1) AS n FROM documents),
    b AS (SELECT doc_id, trim(s, {SQL_WS}) AS s FROM s, q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(list_transform(regexp_extract_all(s, '[A-Za-z0-9_/-]+'), lambda x: lower(x)), t)) DESC, n) = 1)
    SELECT doc_id, CASE WHEN length(s) > 260 THEN substr(s, 1, 259) || '…' ELSE s END AS best FROM b"""
)
def best_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.best_sentence(F.lit(QUESTION), "text").alias("best"))


@query(
    """WITH c AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' I Don''t know.' WHEN 1 THEN ' There is not enough information' ELSE '' END AS t FROM conversations)
    SELECT conv_id, turn, contains(lower(t), 'i don''t know') OR contains(lower(t), 'not enough information') AS abstained FROM c"""
)
def abstention(spark, d):
    more = F.when(F.col("conv_id") % 4 == 0, " I Don't know.").when(F.col("conv_id") % 4 == 1, " There is not enough information").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.abstained(F.concat("text", more)).alias("abstained"))


def _note():
    return F.concat(F.lit("---\ntags: ["), "lang", F.lit(", Moc"), (F.col("doc_id") % 5).cast("string"), F.lit("]\ntype: "), "source", F.lit("\n---\n## "), "source", F.lit("\n"), "text")


@query(
    """SELECT doc_id, 'tags: [' || lang || ', Moc' || doc_id % 5 || ']' || chr(10) || 'type: ' || source AS source, '## ' || source || chr(10) || text AS body,
    [lang, 'Moc' || doc_id % 5] AS tags FROM documents"""
)
def front_matter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", md.front_matter(_note()).alias("f"))
    parsed = md.front_matter_json("f.source")
    return docs.select("doc_id", "f.source", "f.body", md.normalize_tags(F.get_json_object(parsed, "$.tags")).alias("tags"))


TAGGED_SQL = "'#' || lang || ' x#no (#a/' || source || ')' || chr(10) || text || ' é#no #last'"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace({TAGGED_SQL}, '([/-])#', '\1 #', 'g') AS t FROM documents)
    SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '(?:^|[^\pL\pM\p{{Nd}}\p{{Nl}}\p{{Pc}}])#([A-Za-z0-9/_-]+)', 1))) AS tags FROM t"""
)
def tags_inline(spark, d):
    """Tags of the texts as they are. The SQL parts a tag that ends in / or - from a tag right after it, as its patterns cannot look back."""
    decorated = F.concat(F.lit("#"), "lang", F.lit(" x#no (#a/"), "source", F.lit(")\n"), "text", F.lit(" é#no #last"))
    return table(spark, d, "documents").select("doc_id", md.inline_tags(decorated).alias("tags"))


@query("""SELECT doc_id, lang || ' ' || source || ' !b' || chr(10) || text || chr(10) || '```x' || chr(10) || '[[kept]]' || chr(10) || '```' || chr(10) || 'end' AS text FROM documents""")
def wikilinks(spark, d):
    note = F.concat(F.lit("[[t | "), "lang", F.lit(" ]] [["), "source", F.lit("|  ]] ![[ b ]]\n"), "text", F.lit("\n```x\n[[kept]]\n```\nend"))
    return table(spark, d, "documents").select("doc_id", md.strip_links(note).alias("text"))


@query(
    """SELECT doc_id, unnest(['a' || chr(10) || '``` py' || chr(10), text || chr(10) || ' ```' || chr(10), 'b' || chr(10)]) AS text, unnest([false, true, false]) AS is_code, unnest([0, 1, 2]) AS n FROM documents"""
)
def fence_split(spark, d):
    note = F.concat(F.lit("a\n``` py\n"), "text", F.lit("\n ```\nb\n"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(md.segments(note)).alias("n", "s")).select("doc_id", "s.*", "n")


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace('# Top' || chr(10) || 'lead' || chr(10) || chr(10) || '## ' || source || '  ' || chr(10) || text || chr(10) || '### x', '\r\n|\r', chr(10), 'g') AS t FROM documents),
    m AS (SELECT doc_id, string_split(replace(regexp_replace(t, '(?m)^(?:(#{{2,6}}{RE_WS}+.+?){RE_WS}*$|(#{RE_WS}+.+?{RE_WS}*$))', chr(1) || '\1' || chr(2) || '\2', 'g'), chr(1) || chr(2), ''), chr(1)) AS parts FROM t),
    p AS (SELECT doc_id, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m)
    SELECT doc_id, CASE WHEN i > 1 THEN trim(string_split(part, chr(2))[1], {SQL_WS}) END AS heading, trim(string_split(part, chr(2))[-1], {SQL_WS}) AS body, CAST(i - 1 AS INT) AS n FROM p"""
)
def heading_split(spark, d):
    """Sections of all texts as they are, those with headings of their own too."""
    note = F.concat(F.lit("# Top\nlead\n\n## "), "source", F.lit("  \n"), "text", F.lit("\n### x"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(md.sections(note)).alias("n", "s")).select("doc_id", "s.*", "n")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 OR lang = 'en' THEN 'moc' ELSE 'note' END AS new, CASE WHEN doc_id % 3 = 0 THEN 'moc' ELSE 'note' END AS legacy FROM documents"""
)
def classify_note(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, "Democracy.md").otherwise("note.md")
    kind = F.when(F.col("doc_id") % 4 == 0, "MOC")
    tags = F.when(F.col("lang") == "en", F.array(F.lit("Moc"))).otherwise(F.array(F.lit("x")))
    return table(spark, d, "documents").select("doc_id", md.classify(name, kind, tags).alias("new"), md.classify(name, kind, tags, legacy=True).alias("legacy"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'AI' ELSE source END AS root_dir, CASE WHEN doc_id % 2 = 0 THEN 'AI/' || source ELSE source END AS relative_dir, doc_id % 2 = 0 AS is_ai FROM documents"""
)
def path_features(spark, d):
    path = F.concat(F.lit("/v/"), F.when(F.col("doc_id") % 2 == 0, "AI/").otherwise(""), "source", F.lit("/n.md"))
    return table(spark, d, "documents").select("doc_id", md.path_features(path).alias("p")).select("doc_id", "p.*")


OUTCOMES_SQL = """o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.csv' END AS ext,
  CASE WHEN doc_id % 13 = 0 THEN 'skipped_hidden' WHEN doc_id % 3 = 2 THEN 'skipped_extension' WHEN doc_id % 17 = 0 THEN 'failed'
       WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'skipped_empty' ELSE 'skipped_too_large' END WHEN doc_id % 11 = 0 THEN 'skipped_empty' ELSE 'loaded' END AS outcome FROM documents)"""


def outcomes(spark, d):
    n = F.col("doc_id")
    path = F.concat(F.lit("/v/"), F.when(n % 13 == 0, ".").otherwise(""), F.lit("h/n"), F.when(n % 3 == 0, ".md").when(n % 3 == 1, ".TXT").otherwise(".csv"))
    text = F.when(n % 7 != 0, F.when(n % 11 == 0, " \n").otherwise(F.col("text")))
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"), text.alias("text"))
    return rows.select("doc_id", files.extension("path").alias("ext"), "path", files.outcome(failed=n % 17 == 0).alias("outcome"))


@query(f"WITH {OUTCOMES_SQL} SELECT doc_id, ext, outcome FROM o")
def ingest_outcome(spark, d):
    return outcomes(spark, d).select("doc_id", "ext", "outcome")


@query(
    f"""WITH {OUTCOMES_SQL} SELECT count(*) AS scanned, {", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in files.OUTCOMES)},
    count(*) FILTER (outcome = 'loaded' AND ext = '.md') AS md, count(*) FILTER (outcome = 'loaded' AND ext = '.txt') AS txt FROM o"""
)
def ingest_report(spark, d):
    found = files.report(outcomes(spark, d))
    by = [F.coalesce(F.element_at("by_extension", f".{x}"), F.lit(0).cast("long")).alias(x) for x in ("md", "txt")]
    return found.select("scanned", *files.OUTCOMES, *by)


@query(
    """SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 1 AS is_binary, CASE doc_id % 4 WHEN 0 THEN text || chr(0) WHEN 1 THEN repeat(chr(1), 200) || text
    WHEN 2 THEN list_aggregate(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: chr(CAST('0x' || x AS INT))), 'string_agg', '') || 'é' ELSE text END AS decoded FROM documents"""
)
def binary_and_decoding(spark, d):
    """A NUL byte at the end, over 2 % controls, bytes that are no UTF-8 (all read as latin-1), or plain text."""
    n, raw = F.col("doc_id"), F.col("text").cast("binary")
    controls = F.concat(F.repeat(F.lit("\x01"), 200).cast("binary"), raw)
    content = F.when(n % 4 == 0, F.concat(raw, F.unhex(F.lit("00")))).when(n % 4 == 1, controls).when(n % 4 == 2, F.concat(raw, F.unhex(F.lit("E9")))).otherwise(raw)
    rows = table(spark, d, "documents").select("doc_id", content.alias("c"))
    return rows.select("doc_id", files.looks_binary("c").alias("is_binary"), files.decoded("c").alias("decoded"))


def of_files(spark, d, label, use):
    """What ``use`` makes of a folder in which each document is a file in a folder of its own, beside the mark that all are written.

    A small file and its folder take a block of the disk each, five times the table in all. So the documents are written, used and deleted
    a share at a time; ``use`` gives rows that need the folder no more.
    """
    folder, made = new_path(spark, label), []
    name = F.concat(F.lit("n="), F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    for n in range(SHARES):
        files.write_texts(table(spark, d, "documents").where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) == n).select(name.alias("folder"), "text"), folder)
        if n == SHARES - 1:
            files.mark_written(folder)
        made.append(use(folder))
        delete(spark, [folder])
    return reduce(DataFrame.unionAll, made)


@query(
    f"""SELECT doc_id, text || chr(10) AS text, '.txt' AS ext, 'filesystem' AS source, CAST(strlen(text) + 1 AS BIGINT) AS size_bytes, sha256(text || chr(10)) AS content_hash
    FROM documents WHERE trim(text, {SQL_WS}) <> '' AND strlen(text) < {files.MAX_BYTES}"""
)
def ingest_files(spark, d):
    """All documents written to a folder each, as text files, and loaded from there."""
    docs = of_files(spark, d, "ingest-files", lambda folder: files.load_documents(spark, [folder])[0])
    return docs.select(F.regexp_extract("uri", "/n=([0-9]+)/", 1).cast("long").alias("doc_id"), "text", "ext", "source", "size_bytes", "content_hash")


RELEVANT_SQL = "rel AS (SELECT q.vec_id AS qid, v.vec_id FROM v JOIN v q ON q.vec_id = (v.vec_id + 50) // 100 * 100 AND q.label = v.label)"


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10), {RELEVANT_SQL},
    n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
    m AS (SELECT t.qid, count(*) AS c, count(*) FILTER (rel.vec_id IS NOT NULL AND rank <= 5) / any_value(n) AS r5, count(*) FILTER (rel.vec_id IS NOT NULL) / any_value(n) AS r10,
          coalesce(1 / min(rank) FILTER (rel.vec_id IS NOT NULL), 0) AS mrr FROM t LEFT JOIN rel USING (qid, vec_id) LEFT JOIN n USING (qid) GROUP BY t.qid)
    SELECT count(*) AS num_queries, round(avg(c), 6) AS avg_retrieved, round(avg(coalesce(r5, 0)), 6) AS recall_at_5, round(avg(coalesce(r10, 0)), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr FROM m"""
)
def eval_summary(spark, d):
    rows = nodes(spark, d)
    near = (F.floor((F.col("vec_id") + 50) / 100) * 100).alias("qid")
    heads = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    relevant = rows.select(near, "vec_id", "label").join(heads, "qid").where("label = wanted").select("qid", "vec_id")
    found = evaluate.summary(evaluate.per_query(asked(rows), batch(spark, d, 10), relevant, item="vec_id"))
    return found.select("num_queries", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5), w AS (SELECT vec_id AS qid, source_path AS wanted FROM v WHERE vec_id % 100 = 0)
    SELECT qid, CAST(max(CASE WHEN source_path = wanted THEN 1 ELSE 0 END) AS INT) AS hit, coalesce(1 / min(rank) FILTER (source_path = wanted), 0) AS mrr, count(*) - count(DISTINCT source_path) AS dupes
    FROM t JOIN w USING (qid) GROUP BY qid"""
)
def eval_by_file(spark, d):
    rows = nodes(spark, d)
    found = batch(spark, d, 5).join(rows.select("vec_id", F.col("source_path").alias("file_name")), "vec_id")
    expected = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("source_path").alias("file_name"))
    return evaluate.by_file(asked(rows), found, expected, 5)


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)
    SELECT qid, CAST(qid AS VARCHAR) AS query, CAST(any_value(q.label) % 3 AS BIGINT) AS relevant_count, list(t.vec_id ORDER BY rank) AS retrieved_top10 FROM t JOIN v q ON q.vec_id = t.qid GROUP BY qid"""
)
def eval_details(spark, d):
    rows = nodes(spark, d)
    asks = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").cast("string").alias("query"), F.array_repeat(F.lit("x"), F.col("label") % 3).alias("relevant_chunk_ids"))
    return evaluate.details(asks, batch(spark, d, 10), item="vec_id")


@query("SELECT doc_id AS node_id, source AS file_name, substr(text, 1, 600) AS text_preview, CAST(NULL AS VARCHAR) AS is_moc FROM documents")
def retrieval_dump_rows(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("file_name"), "text")
    return store.retrieval_rows(rows).select("node_id", "file_name", "text_preview", "is_moc")


@query(
    """WITH n AS (SELECT doc_id, text, doc_id % 2 = 0 AS even FROM documents)
    SELECT '/v/n' || doc_id || '.md' AS path, CASE WHEN even THEN 'top' || chr(10) || chr(10) || chr(10) || '<!-- EMBED: part.md -->' || chr(10) || 'part body' || chr(10) || '<!-- /EMBED -->' || chr(10) || chr(10) || ' ' || text ELSE text END AS text FROM n"""
)
def embeds_expanded(spark, d):
    """Every other document embeds one shared note."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("/v/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("top\n![[part#h|x]] "), "text")).otherwise(F.col("text")).alias("body"))
    part = spark.createDataFrame([("/v/sub/part.md", "part body")], "path string, body string")
    return notes.expand_embeds(docs, docs.union(part), "/v")


@query(f"WITH {ALL_SCORES_SQL} SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def knn_cells(spark, d):
    """The same as knn_batch, by a persistent index of cells."""
    rows = nodes(spark, d)
    index = cells.build(rows.select("vec_id", "vector"), new_path(spark, "cells"), "vec_id")
    return index.search_all(asked(rows), 10)


@query(
    """SELECT doc_id, 'part.txt' AS name, CAST(strlen(text) + 1 AS BIGINT) AS size FROM documents UNION ALL SELECT NULL, '_SUCCESS', 0"""
)
def files_listed(spark, d):
    """All documents written to a folder each and listed; the writer's own mark is a file without content and with a leading underscore."""
    found = of_files(spark, d, "files-listed", lambda folder: stage(listing.list_files(spark, [folder]), "files-listed"))
    name = F.regexp_replace(files.file_name("path"), "^part-.*[.]txt$", "part.txt")
    return found.select(F.expr("try_cast(regexp_extract(path, '/n=([0-9]+)/', 1) AS BIGINT)").alias("doc_id"), name.alias("name"), "size")


CHANGED_SQL = "CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END"


@query(
    f"""WITH documents_now AS (SELECT doc_id, {CHANGED_SQL} AS text FROM documents WHERE doc_id % 7 <> 0),
    {CHUNKS_SQL.replace("FROM documents", "FROM documents_now")} SELECT doc_id, chunk_index, start_char, end_char, text FROM chunks"""
)
def index_after_changes(spark, d):
    """An index after two batches, one given twice, then edits and deletions: as one built anew."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uri"), "text")
    index = VersionedTable(spark, new_path(spark, "index-versions"))
    none = spark.createDataFrame([], "uri string")
    for n, some in enumerate((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 1"))):
        sync.apply_documents(index, some, none, ("documents", min(n, 1)))
    edited = docs.where("doc_id % 5 = 0 AND doc_id % 7 <> 0").withColumn("text", F.concat("text", F.lit(" edited")))
    sync.apply_documents(index, edited, docs.where("doc_id % 7 = 0").select("uri"), ("documents", 2))
    return index.read().select("doc_id", "chunk_index", "start_char", "end_char", "text")


@query(
    f"""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]){RE_WS}+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
    p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM w),
    c AS (SELECT doc_id, i, s, trim(substr(part, s + 1, 1200), {SQL_WS}) AS text FROM p, LATERAL (SELECT unnest(range(0, greatest(length(part), 1), 1200)) AS s)),
    t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) AS n, text FROM c WHERE text <> ''),
    v AS (SELECT *, {_digest_sql("text")} AS e FROM t),
    a AS (SELECT doc_id, n, text, round(1 - list_cosine_similarity(lag(e) OVER (PARTITION BY doc_id ORDER BY n), e), 6) AS apart FROM v),
    m AS (SELECT doc_id, quantile_cont(apart, 0.95) AS most FROM a GROUP BY doc_id),
    g AS (SELECT a.doc_id, n, text, sum(CASE WHEN apart > most THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY n) AS segment FROM a JOIN m USING (doc_id)),
    h AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, segment ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1200 AS part FROM g),
    r AS (SELECT doc_id, min(n) AS n, string_agg(text, ' ' ORDER BY n) AS text, count(*) AS sentences FROM h GROUP BY doc_id, segment, part)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS chunk_index, text, sentences FROM r"""
)
def chunk_semantic(spark, d):
    return chunk.semantic(table(spark, d, "documents"))


@query(
    f"""WITH {ALL_SCORES_SQL}, t AS (SELECT qid // 300 * 300 AS whole, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20),
    f AS (SELECT whole AS qid, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM t GROUP BY whole, vec_id)
    SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM f QUALIFY rank <= 10"""
)
def fused_parts(spark, d):
    """Questions of up to three parts, each a vector of its own."""
    found = batch(spark, d, 20).withColumn("qid", F.expr("qid div 300 * 300"))
    return explore.fuse(found, 10, "vec_id")


@query(
    f"""WITH RECURSIVE {VECTORS_SQL}, e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a, v b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) <= 3),
    h AS (SELECT vec_id AS qid, vec_id, 0 AS hop FROM v WHERE vec_id % 100 = 0 UNION SELECT h.qid, e.dst, h.hop + 1 FROM h JOIN e ON e.src = h.vec_id WHERE h.hop < 3)
    SELECT qid, vec_id, CAST(min(hop) AS INT) AS hop FROM h GROUP BY qid, vec_id"""
)
def multi_hop(spark, d):
    """Rows reached from each question in three steps, each to the three nearest rows."""
    rows = nodes(spark, d)
    start = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vec_id")
    return explore.hops(start, explore.nearest(rows.select("vec_id", "vector"), 3, "vec_id"), 3, item="vec_id")
