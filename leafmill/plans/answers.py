"""Queries of the first-generation flow, of prompts and of what surrounds a model's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import answering, catalog, fusion, prompts, routing
from leafmill.plans import content as C
from leafmill.plans import search as S
from leafmill.plans.search import _posts, _questions, _stored, _t
from leafmill.session import sized

AS_OF = "2024-06-01"


def rrf_text_key(spark: SparkSession, d: str) -> DataFrame:
    """Fusion by the text's first characters; stored hits with an even id are vector hits, the others keyword hits."""
    h = _stored(spark, d).withColumn("is_vec", F.col("result_id") % 2 == 0)
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "is_vec").orderBy("pos")))
    out = fusion.rrf_by_text(h.select("query_id", "text", "result_id", "is_vec", "rank"), extra=["result_id"])
    return out.select("query_id", "result_id", "score", "place")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "documents").where("length(text) > 0")
    return x.select(F.col("doc_id").alias("key"), F.coalesce("filename", F.lit("unknown")).alias("filename"), "text", F.col("ingested_at").alias("at"), T.looks_like_table(F.col("text")).alias("has_table"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The questions with the file they name, kept, as they are read for each of the searches."""
    docs = _t(spark, d, "documents").where("filename <> ''")
    ids = docs.groupBy("filename").agg(F.min("doc_id").alias("doc_id")).select("doc_id").persist()
    first = docs.join(sized(ids), "doc_id", "left_semi")  # no text is shuffled to find a file's first
    q = _questions(spark, d)
    return q.join(routing.detect(q, routing.alias_lists(first, "text")).select("query_id", F.col("filename").alias("file")), "query_id", "left").persist()


def v1_hybrid(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return answering.hybrid(_posts(spark, d), items, _named(spark, d), _texts(spark, d), 3, 0.1, as_of).select("query_id", F.col("key").alias("doc_id"), "score", "pos")


def subquery_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Each question's parts searched on their own, expanded; parts are those of the fallback split."""
    q = _named(spark, d).select("query_id", F.posexplode(T.fallback_split(F.col("query"))).alias("sub", "part"), "vector", "file")
    parts = q.select((F.col("query_id") * 10 + F.col("sub")).alias("query_id"), T.expand_query(F.col("part")).alias("query"), "vector", "file")
    items = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    found = answering.hybrid(_posts(spark, d), items, parts, _texts(spark, d), 3, 0.1, F.lit(AS_OF).cast("timestamp_ntz"))
    return found.select(F.floor(F.col("query_id") / 10).cast("bigint").alias("query_id"), (F.col("query_id") % 10).alias("sub_query_index"), F.col("key").alias("doc_id"), "score", "pos")


def unified_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """What a question whose parts all point to one file gets."""
    items = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return answering.collapsed(_posts(spark, d), items, _named(spark, d), _texts(spark, d), 0.1, F.lit(AS_OF).cast("timestamp_ntz")).select("query_id", F.col("key").alias("doc_id"), "score", "pick")


def assemble_context(spark: SparkSession, d: str) -> DataFrame:
    h = _stored(spark, d).select("query_id", F.col("result_id").alias("key"), F.coalesce("filename", F.lit("unknown")).alias("filename"), "text", "score", F.col("pos").alias("at"))
    return answering.assemble(h, 3).withColumnRenamed("key", "result_id")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("query_id", "pos", F.coalesce("filename", F.lit("")).alias("filename"), F.col("page_num").alias("page"), "doc_id", "page_num", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id").distinct().withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """The messages whose id, in tens, is a question's id stand for its history."""
    return _t(spark, d, "session_messages").select(F.floor(F.col("id") / 10).cast("bigint").alias("query_id"), F.col("id").alias("pos"), F.lower(F.coalesce("role", F.lit(""))).alias("role"), "content")


def prompt_v1(spark: SparkSession, d: str) -> DataFrame:
    at = _t(spark, d, "doc_versions").select(F.col("id").alias("doc_id"), F.col("ingested_at").alias("at"))
    p = prompts.excerpts(_hits(spark, d).join(at, "doc_id", "left"), _asked(spark, d))
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"))


def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    """Pages by document with the history before them; the instruction's language is that of the question's id."""
    heads = _t(spark, d, "search_results").select("query_id", "result_id", F.when(F.coalesce("headers", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("headers", r" \| ")).alias("headers"))
    pages = _stored(spark, d).join(heads, ["query_id", "result_id"]).select("query_id", "doc_id", "page_num", F.coalesce("filename", F.lit("")).alias("filename"), "headers", F.col("text").alias("raw_text"))
    pages = pages.groupBy("query_id", "doc_id", "page_num").agg(F.min(F.struct("filename", "headers", "raw_text")).alias("x")).select("query_id", "doc_id", "page_num", "x.*")
    p = prompts.pages(pages, _asked(spark, d), _turns(spark, d))
    language = F.when(F.col("query_id") % 2 == 0, "nl-NL").otherwise("en")
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"), F.md5(prompts.system(language)).alias("system_md5"))


def prompt_web(spark: SparkSession, d: str) -> DataFrame:
    """Stored hits as a search provider's rows."""
    h = _stored(spark, d).select("query_id", F.col("pos").alias("rank"), F.col("filename").alias("title"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url"), F.when(F.col("pos") % 2 == 0, F.col("text")).alias("content"), F.col("doc_id").alias("snippet"))
    p = prompts.web(prompts.web_results(h), _asked(spark, d))
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"))


def contextualise(spark: SparkSession, d: str) -> DataFrame:
    """Each message as a rewriting of the one before it in its session."""
    m = _t(spark, d, "session_messages").where("session_id is not null and content is not null")
    m = m.withColumn("before", F.lag("content").over(Window.partitionBy("session_id").orderBy("id"))).where("before is not null")
    return m.select("id", F.md5(T.standalone(F.col("content"), F.col("before"))).alias("question_md5"))


def json_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Headings as a model's JSON answer, in a code fence for even ids; pages without headings take the fallback."""
    p = _t(spark, d, "pages").where("raw_text is not null")
    js = F.to_json(F.coalesce("headers", F.array().cast("array<string>")))
    answer = F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    return p.select("id", F.posexplode(T.parsed_subqueries(answer, F.col("raw_text"))).alias("part", "text")).select("id", F.col("part").cast("bigint").alias("part"), F.md5("text").alias("text_md5"))


def result_text(spark: SparkSession, d: str) -> DataFrame:
    """A hit's text is its summary where it has one, else the page's text; flags are never null."""
    p = catalog.latest(_t(spark, d, "pages").where("raw_text is not null"), ["doc_id", "page_num"], [F.asc("id")]).select("doc_id", "page_num", "raw_text")
    h = _t(spark, d, "search_results").join(p, ["doc_id", "page_num"], "left")
    return h.select("result_id", F.md5(F.coalesce(F.nullif("summary_text", F.lit("")), "raw_text", F.lit(""))).alias("text_md5"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"))


def answer_events(spark: SparkSession, d: str) -> DataFrame:
    """A stored answer played back as lines of JSON: a first event, the text in pieces of 40 characters, the sources last."""
    m = _t(spark, d, "session_messages").where("content is not null")
    n = F.ceil(F.length("content") / 40).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * 40 + 1, F.lit(40)))
    token = F.when(n > 0, F.transform(pieces, lambda x: F.to_json(F.struct(F.lit("token").alias("type"), x.alias("data"))))).otherwise(F.array().cast("array<string>"))
    first = F.array(F.to_json(F.struct(F.lit("cache_hit").alias("type"), F.lit(True).alias("data"))))
    last = F.array(F.to_json(F.struct(F.lit("sources").alias("type"), F.array(F.col("id")).alias("data"))))
    lines = m.select("id", F.posexplode(F.concat(first, token, last)).alias("pos", "line"))
    return lines.select("id", F.col("pos").cast("bigint").alias("pos"), F.get_json_object("line", "$.type").alias("type"), F.get_json_object("line", "$.data").alias("data"))


QUERIES = [rrf_text_key, v1_hybrid, subquery_retrieval, unified_retrieval, assemble_context, prompt_v1, prompt_history, prompt_web, contextualise, json_subqueries, result_text, answer_events]

_TEXTS = "texts AS (SELECT doc_id, coalesce(filename, 'unknown') AS filename, text, ingested_at AS came FROM documents WHERE length(text) > 0)"
_FIRST = "(SELECT filename, arg_min(coalesce(text, ''), doc_id) AS t FROM documents WHERE filename <> '' GROUP BY ALL)"
_AL = S._ALIAS.replace("f AS (SELECT filename, arg_min(coalesce(summary_text, ''), result_id) AS t FROM search_results WHERE filename <> '' GROUP BY ALL)", f"f AS {_FIRST}")
_DETECT = rf"""{_AL},
qw AS (SELECT DISTINCT query_id, alias FROM (SELECT query_id, lower(unnest(list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))) AS alias FROM q0 UNION ALL SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{4,}}')) FROM q0)),
dt AS (SELECT query_id, arg_min(filename, (-shared, filename)) AS file FROM (SELECT query_id, filename, count(*) AS shared FROM qw JOIN al USING (alias) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)"""


def _hybrid(n: int) -> str:
    """Over q (query_id, query, vector, file)."""
    return f"""{S._bm25('[a-z0-9]+', n)},
vv AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT q.query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON q.vector IS NOT NULL LEFT JOIN texts t ON t.doc_id = e.vec_id WHERE q.file IS NULL OR t.filename = q.file)) WHERE rank <= {n} AND round(score, 4) >= 0.1),
bb AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bm JOIN texts USING (doc_id) JOIN (SELECT query_id, file FROM q) USING (query_id) WHERE file IS NULL OR filename = file),
hh AS (SELECT query_id, doc_id, rank, true AS is_vec FROM vv UNION ALL SELECT query_id, doc_id, rank, false FROM bb),
fz AS (SELECT query_id, sum(1.0::DOUBLE / (60 + rank)) AS total, min((NOT is_vec, rank)) AS first, arg_max(doc_id, (is_vec, CASE WHEN is_vec THEN rank ELSE -rank END)) AS doc_id, arg_max(came, (is_vec, CASE WHEN is_vec THEN rank ELSE -rank END)) AS came
  FROM hh JOIN texts USING (doc_id) GROUP BY query_id, substr(text, 1, 120)),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 12) DESC, first) AS place FROM fz),
sc AS (SELECT query_id, doc_id, place, coalesce(round(round(total, 6) + 0.01::DOUBLE * exp(-greatest(date_diff('day', came::DATE, DATE '{AS_OF}'), 0) / 365.0::DOUBLE), 6), round(total, 6)) AS score FROM pl),
v1 AS (SELECT query_id, doc_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS pos FROM sc) WHERE pos <= {n})"""


_BASE = f"{S._DOCS}, {_TEXTS}, {S._Q.replace('q AS', 'q0 AS')}, {_DETECT}"


def mmr_sql(source: str, k: int) -> str:
    """The greedy choice as a recursion over `source` (query_id, pos, id, document, score): mm (query_id, id, pick)."""
    return f"""
c0 AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(document), '\\s+'), lambda w: w <> '')) AS w, count(*) OVER (PARTITION BY query_id) AS n, coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1.0) AS top FROM {source}),
sim AS (SELECT a.query_id, a.pos, map_from_entries(list((b.pos, CASE WHEN len(a.w) + len(b.w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END))) AS s FROM c0 a JOIN c0 b ON a.query_id = b.query_id GROUP BY ALL),
c AS (SELECT c0.query_id, c0.pos, c0.score / c0.top AS rel, s FROM c0 JOIN sim ON sim.query_id = c0.query_id AND sim.pos = c0.pos WHERE n > {k}),
pk AS (SELECT query_id, 1 AS step, [arg_min(pos, (-rel, pos))] AS picked FROM c GROUP BY query_id
  UNION ALL SELECT query_id, step + 1, list_append(picked, best) FROM (SELECT pk.query_id, pk.step, pk.picked, arg_min(c.pos, (-(0.6::DOUBLE * c.rel - 0.4::DOUBLE * list_max(list_transform(pk.picked, lambda p: c.s[p]))), c.pos)) AS best
    FROM pk JOIN c ON c.query_id = pk.query_id AND NOT list_contains(pk.picked, c.pos) WHERE pk.step < {k} GROUP BY ALL)),
mm AS (SELECT l.query_id, c0.id, l.pick FROM (SELECT query_id, unnest(picked) AS pos, unnest(range(1, len(picked) + 1)) AS pick FROM pk WHERE step = {k}) l JOIN c0 ON c0.query_id = l.query_id AND c0.pos = l.pos
  UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) FROM c0 WHERE n <= {k})"""


_HIT_LINES = "coalesce(filename, '')"
SQL = {
    "rrf_text_key": f"""WITH {S._STORED}, h AS (SELECT *, result_id % 2 = 0 AS is_vec, row_number() OVER (PARTITION BY query_id, result_id % 2 = 0 ORDER BY pos) AS rank FROM stored),
        f AS (SELECT query_id, sum(1.0::DOUBLE / (60 + rank)) AS total, min((NOT is_vec, rank)) AS first, arg_max(result_id, (is_vec, CASE WHEN is_vec THEN rank ELSE -rank END)) AS result_id FROM h GROUP BY query_id, substr(text, 1, 120))
        SELECT query_id, result_id, round(total, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 12) DESC, first) AS place FROM f""",
    "v1_hybrid": f"WITH {_BASE}, q AS (SELECT q0.*, dt.file FROM q0 LEFT JOIN dt USING (query_id)), {_hybrid(9)} SELECT query_id, doc_id, score, pos FROM v1",
    "subquery_retrieval": f"""WITH {_BASE}, q AS (SELECT query_id * 10 + sub AS query_id, CASE WHEN {C._WORDS.format('part')} < 8 THEN 'Provide detailed information about ' || part || '. Include definitions, context and details.' ELSE part END AS query, vector, file
        FROM (SELECT query_id, vector, file, unnest(range(len(parts))) AS sub, unnest(parts) AS part FROM (SELECT query_id, vector, file, CASE {C._SPLIT} ELSE [content] END AS parts FROM (SELECT q0.query_id, q0.query AS content, q0.vector, dt.file FROM q0 LEFT JOIN dt USING (query_id))))), {_hybrid(9)}
        SELECT query_id // 10 AS query_id, query_id % 10 AS sub_query_index, doc_id, score, pos FROM v1""",
    "unified_retrieval": f"""WITH RECURSIVE {_BASE}, q AS (SELECT q0.*, dt.file FROM q0 LEFT JOIN dt USING (query_id)), {_hybrid(60)},
        bo AS (SELECT v1.query_id, v1.doc_id AS id, texts.text AS document, v1.pos AS o, CASE WHEN {C._TABLE.replace('raw_text', 'texts.text')} AND ({C._any('lower(q.query)', T.TABLE_BOOST)} OR len(regexp_extract_all(q.query, '\\b(?:19|20)\\d{{2}}\\b')) >= 2) THEN round(v1.score + 0.02::DOUBLE, 6) ELSE v1.score END AS score FROM v1 JOIN texts USING (doc_id) JOIN q ON q.query_id = v1.query_id),
        tt AS (SELECT query_id, id, document, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS pos FROM bo), {mmr_sql('tt', 10)}
        SELECT mm.query_id, mm.id AS doc_id, tt.score, mm.pick FROM mm JOIN tt ON tt.query_id = mm.query_id AND tt.id = mm.id""",
    "mmr_select": f"""WITH RECURSIVE r AS (SELECT query_id, result_id AS id, coalesce(summary_text, '') AS document, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, result_id) AS pos FROM search_results), {mmr_sql('r', 3)}
        SELECT query_id, id AS result_id, pick FROM mm""",
    "assemble_context": f"""WITH RECURSIVE {S._STORED}, st AS (SELECT * REPLACE (coalesce(filename, 'unknown') AS filename) FROM stored), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(text, 1, 120) ORDER BY pos) AS rn FROM st) WHERE rn = 1),
        t AS (SELECT query_id, result_id AS id, filename, text AS document, score, pos AS o, row_number() OVER (PARTITION BY query_id ORDER BY r, f) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY pos) AS r, min(pos) OVER (PARTITION BY query_id, filename) AS f FROM o)),
        {mmr_sql('t', 3)}, p AS (SELECT mm.*, t.filename, t.o FROM mm JOIN t ON t.query_id = mm.query_id AND t.id = mm.id),
        a AS (SELECT query_id, id, NULL::BIGINT AS pick, filename, o FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY o) AS rn FROM t) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = x.query_id AND p.filename = x.filename))
        SELECT query_id, id AS result_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY pick NULLS LAST, o) AS pick FROM (SELECT * FROM p UNION ALL SELECT * FROM a)""",
    "prompt_v1": f"""WITH {S._STORED}, b AS (SELECT s.query_id, s.pos, '[' || {_HIT_LINES} || ', Page ' || page_num || ', Ingested: ' || coalesce(strftime(v.ingested_at, '%Y-%m-%d'), 'unknown') || ']' || chr(10) || s.text AS line FROM (SELECT * FROM stored) s LEFT JOIN (SELECT id, ingested_at FROM doc_versions) v ON v.id = s.doc_id)
        SELECT query_id, md5('Using the document excerpts below, answer the question at the end.' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Question: q' || query_id) AS prompt_md5 FROM b GROUP BY query_id""",
    "prompt_history": f"""WITH {S._STORED}, g AS (SELECT s.query_id, s.doc_id, s.page_num, min((coalesce(s.filename, ''), CASE WHEN coalesce(r.headers, '') = '' THEN []::VARCHAR[] ELSE string_split(r.headers, ' | ') END, s.text)) AS x FROM stored s JOIN search_results r USING (result_id) GROUP BY ALL),
        b AS (SELECT query_id, string_agg('=== ' || x[1] || ' — Page ' || page_num || CASE WHEN len(x[2]) > 0 THEN '  [' || array_to_string(x[2], ' > ') || ']' ELSE '' END || ' ===' || chr(10) || x[3] || chr(10) || '=== END PAGE ===' || chr(10), chr(10) ORDER BY doc_id NULLS FIRST, page_num NULLS FIRST) AS body FROM g GROUP BY query_id),
        m AS (SELECT id // 10 AS query_id, string_agg(CASE WHEN lower(coalesce(role, '')) = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(content, ''), chr(10) ORDER BY id) AS said FROM session_messages GROUP BY ALL)
        SELECT query_id, md5(coalesce('--- CONVERSATION SO FAR ---' || chr(10) || chr(10) || said || chr(10) || '--- END CONVERSATION ---' || chr(10) || chr(10), '') || '--- DOCUMENT PAGES ---' || chr(10) || chr(10) || body || chr(10) || '--- END DOCUMENT PAGES ---' || chr(10) || chr(10) || 'Question: q' || query_id) AS prompt_md5,
          md5(CASE WHEN query_id % 2 = 0 THEN '{prompts.SYSTEM["nl"].replace("'", "''")}' ELSE '{prompts.SYSTEM["en"]}' END) AS system_md5 FROM b LEFT JOIN m USING (query_id)""",
    "prompt_web": f"""WITH {S._STORED}, r AS (SELECT query_id, pos, trim(coalesce(filename, '')) AS title, 'https://example.org/' || doc_id AS url, trim(coalesce(CASE WHEN pos % 2 = 0 THEN text END, doc_id, '')) AS snippet FROM stored WHERE pos <= 5),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM r WHERE title <> '' AND url <> ''),
        b AS (SELECT query_id, string_agg('[' || n || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || snippet || chr(10), chr(10) ORDER BY n) AS body FROM k GROUP BY query_id)
        SELECT query_id, md5('--- WEB RESULTS ---' || chr(10) || chr(10) || coalesce(body || chr(10), '') || '--- END WEB RESULTS ---' || chr(10) || chr(10) || 'Question: q' || query_id) AS prompt_md5 FROM (SELECT DISTINCT query_id FROM stored) LEFT JOIN b USING (query_id)""",
    "contextualise": r"""WITH m AS (SELECT id, content, lag(content) OVER (PARTITION BY session_id ORDER BY id) AS b FROM session_messages WHERE session_id IS NOT NULL AND content IS NOT NULL),
        t AS (SELECT id, b, regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g') AS t FROM m WHERE b IS NOT NULL) SELECT id, md5(CASE WHEN t <> '' AND length(t) < 500 THEN t ELSE b END) AS question_md5 FROM t""",
    "json_subqueries": rf"""WITH h AS (SELECT id, raw_text AS content, list_filter(list_transform(coalesce(headers, []), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS h FROM pages WHERE raw_text IS NOT NULL),
        p AS (SELECT id, CASE WHEN len(h) > 0 THEN h ELSE CASE {C._SPLIT} ELSE [content] END END AS parts FROM h) SELECT id, unnest(range(len(parts))) AS part, md5(unnest(parts)) AS text_md5 FROM p""",
    "result_text": "WITH p AS (SELECT doc_id, page_num, arg_min(raw_text, id) AS t FROM pages WHERE raw_text IS NOT NULL GROUP BY ALL) SELECT result_id, md5(coalesce(nullif(summary_text, ''), t, '')) AS text_md5, coalesce(has_tables, false) AS has_tables FROM search_results r LEFT JOIN p ON p.doc_id = r.doc_id AND p.page_num = r.page_num",
    "answer_events": """WITH m AS (SELECT id, content, ceil(length(content) / 40.0)::INT AS n FROM session_messages WHERE content IS NOT NULL)
        SELECT id, 0::BIGINT AS pos, 'cache_hit' AS type, 'true' AS data FROM m UNION ALL SELECT id, n + 1, 'sources', '[' || id || ']' FROM m
        UNION ALL SELECT id, i + 1, 'token', substr(content, i * 40 + 1, 40) FROM (SELECT id, content, unnest(range(n)) AS i FROM m)""",
}
