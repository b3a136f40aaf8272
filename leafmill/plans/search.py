"""Retrieval queries: keyword, vector and hybrid search and what follows them.

Questions are the documents whose id is divisible by 50, by their whole text, with their vector where they have one (keyword searches
need none). A document's key is (source, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import context, fusion, lexical, routing
from leafmill.operators.vector import cosine, hash_embed, vector_topk
from leafmill.session import shared_folder

TOP_K, HARD, SOFT = 8, 0.25, 0.15


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("length(text) > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", "filename")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("doc_id % 50 = 0").join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), "vector")


def _vectors(spark: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e if parity is None else e.where(f"vec_id % 2 = {parity}")


def _posts(spark: SparkSession, d: str, tokens=T.ascii_tokens) -> DataFrame:
    """The corpus, split into words by each that counts or scores it."""
    return lexical.split(_docs(spark, d), "doc_id", "text", tokens)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_posts(spark, d), _questions(spark, d), 10).withColumnRenamed("key", "doc_id")


def bm25_unicode_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_posts(spark, d, T.unicode_tokens), _questions(spark, d), 10, T.unicode_tokens).withColumnRenamed("key", "doc_id")


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    posts = _posts(spark, d)
    _, size = lexical.corpus_stats(posts)
    return size.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


def _union(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages and chunks as one corpus."""
    pages = _t(spark, d, "pages").where("length(raw_text) > 0").select(F.concat(F.lit("p"), F.col("id")).alias("k"), F.col("raw_text").alias("text"))
    chunks = _t(spark, d, "document_chunks").where("length(text) > 0").select(F.concat(F.lit("c"), F.col("id")).alias("k"), "text")
    return pages.unionByName(chunks)


def bm25_union_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The best of pages and chunks together for each question."""
    posts = lexical.split(_union(spark, d), "k", "text")
    return lexical.bm25(posts, _questions(spark, d), 10)


def bm25_summary_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold tables are searched with their summary put before their text; questions are the glossary's terms."""
    s = _t(spark, d, "page_summaries").where("doc_id is not null and page_num is not null and summary_text is not null").groupBy("doc_id", "page_num").agg(F.min_by("summary_text", "id").alias("s"))
    p = _t(spark, d, "pages").where("length(raw_text) > 0").join(s, ["doc_id", "page_num"], "left").withColumn("s", F.when(F.coalesce("has_tables", F.lit(False)), F.col("s")))
    q = _t(spark, d, "glossary").where("term is not null").select(F.col("term_id").cast("bigint").alias("query_id"), F.col("term").alias("query"))
    return lexical.bm25(lexical.split(p, "id", "raw_text", prefix="s"), q, 5).withColumnRenamed("key", "id")


def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same search over a stored index."""
    posts = lexical.index(_docs(spark, d), "doc_id", "text", f"{shared_folder(spark)}/leafmill/postings")
    return lexical.bm25(posts, _questions(spark, d), 10).withColumnRenamed("key", "doc_id")


def bm25_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter by source is applied behind the cut to the best, so that fewer may remain."""
    q = _questions(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("query_id"), F.col("source").alias("wanted")), "query_id")
    top = lexical.bm25(_posts(spark, d), q, 50).withColumnRenamed("key", "doc_id")
    return top.join(_docs(spark, d).select("doc_id", "source"), "doc_id").join(q.select("query_id", "wanted"), "query_id").where("source = wanted").select("query_id", "doc_id", "score", "rank")


def vector_query(spark: SparkSession, d: str) -> DataFrame:
    return vector_topk(_vectors(spark, d), _questions(spark, d), 10).withColumnRenamed("key", "vec_id")


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold cuts after the k best, with scores to four places."""
    return vector_topk(_vectors(spark, d), _questions(spark, d), 10).withColumn("score", F.round("score", 4)).where("score >= 0.25").withColumnRenamed("key", "vec_id")


def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """An equality filter before the k best."""
    return vector_topk(_vectors(spark, d), _questions(spark, d), 5, where=F.col("label") == 3).withColumnRenamed("key", "vec_id")


def hash_embed_query(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "glossary")
    v = g.select("term_id", hash_embed(F.col("term"), 32).alias("v"))
    return v.select("term_id", F.posexplode("v").alias("bucket", "value")).where("value > 0").select("term_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The three ranked lists of each question: even vectors, odd vectors, keywords."""
    q, n = _questions(spark, d), TOP_K * 5
    docs = _docs(spark, d).select(F.col("doc_id").alias("key"), "source")
    lists = [vector_topk(_vectors(spark, d, p), q, n).withColumn("list_no", F.lit(p + 1)).withColumn("is_vec", F.lit(True)) for p in (0, 1)]
    words = lexical.bm25(_posts(spark, d), q, n).withColumn("list_no", F.lit(3)).withColumn("is_vec", F.lit(False))
    hits = lists[0].unionByName(lists[1]).unionByName(words)
    return hits.join(docs, "key").select("query_id", "source", F.col("key").alias("doc_id"), "score", "rank", "list_no", "is_vec")


def rrf_lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lists(spark, d), ["source", "doc_id"]).select("query_id", "source", "doc_id", "rrf", "rrf_rank", "score", "is_vec")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector lists fused, then spread over sources by the two-tier quota."""
    fused = fusion.rrf(_lists(spark, d), ["source", "doc_id"]).withColumnRenamed("source", "doc")
    return fusion.quota(fused, TOP_K, HARD, SOFT).select("query_id", "doc", "doc_id", "rrf", "rrf_rank", "score", "pos")


def quota_diversity(spark: SparkSession, d: str) -> DataFrame:
    """The quota over stored hits: fusion order is the order of storage."""
    h = _t(spark, d, "search_results").select("query_id", F.col("doc_id").alias("doc"), "result_id", F.round("score", 6).alias("score"))
    from pyspark.sql import Window

    h = h.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id")))
    return fusion.quota(h, 4, 0.5, 0.4).select("query_id", "doc", "result_id", "score", "pos")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    h = _t(spark, d, "search_results").select("query_id", "result_id", F.coalesce("summary_text", F.lit("")).alias("document"), F.round("score", 6).alias("score"))
    h = h.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "result_id")))
    return fusion.mmr(h, 3).select("query_id", "result_id", "pick")


def recency_bias(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "doc_versions").where("id is not null")
    return e.select("id", fusion.recency(F.lit(0.5), F.col("ingested_at"), F.lit("2024-06-01").cast("timestamp_ntz")).alias("score"))


def table_boost(spark: SparkSession, d: str) -> DataFrame:
    h = _t(spark, d, "search_results")
    return h.select("result_id", fusion.table_boost(F.round("score", 6), F.coalesce("summary_text", F.lit("")), F.coalesce("has_tables", F.lit(False))).alias("score"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    h = _t(spark, d, "search_results").select("query_id", "result_id", "doc_id", F.col("page_num").alias("page_num"), F.round("score", 6).alias("score"), F.coalesce("summary_text", F.lit("")).alias("text"), "filename")
    return h.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("result_id")))


def roundrobin_interleave(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(_stored(spark, d).withColumnRenamed("pos", "at"), "doc_id", "at").select("query_id", "result_id", "pos")


def dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_by_prefix(_stored(spark, d), "text", "pos").select("query_id", "result_id")


def multi_topic_merge(spark: SparkSession, d: str) -> DataFrame:
    h = _stored(spark, d).withColumn("sub_idx", F.col("query_id") % 3).withColumn("query_id", F.floor(F.col("query_id") / 3).cast("bigint"))
    return fusion.merge_subqueries(h, ["doc_id", "page_num"], 0.25).select("query_id", "doc_id", "page_num", "score", "sub_idx")


def _one_page(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.catalog import latest

    p = _t(spark, d, "pages").where("raw_text is not null")
    return latest(p, ["doc_id", "page_num"], [F.asc("id")]).select("doc_id", "page_num", "raw_text")


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    h = _stored(spark, d).where("text <> ''")
    return context.neighbours(h.select("query_id", "doc_id", "page_num", "score", "text"), _one_page(spark, d))


def neighbour_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d).select("query_id", "doc_id", "page_num", "is_direct", "score", F.length("raw_text").cast("bigint").alias("n_chars"))


def context_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d).groupBy("query_id").agg(F.floor(F.sum(F.length("raw_text")) / 4).cast("bigint").alias("tokens"), F.count("*").alias("pages"))


def context_sources(spark: SparkSession, d: str) -> DataFrame:
    return context.sources(_stored(spark, d)).select("query_id", "doc_id", "filename", "page_num", "score")


def budget_drop_buffers(spark: SparkSession, d: str) -> DataFrame:
    return context.fit_buffers(_expanded(spark, d), 5000).select("query_id", "doc_id", "page_num", "is_direct")


def budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    e = _expanded(spark, d).where("is_direct")
    return context.truncate(e, 1500).select("query_id", "doc_id", "page_num", F.length("raw_text").cast("bigint").alias("n_chars"))


def prompt_pages(spark: SparkSession, d: str) -> DataFrame:
    h = _stored(spark, d).where("text <> ''")
    head = _t(spark, d, "search_results").select("result_id", F.when(F.coalesce("headers", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("headers", r" \| ")).alias("headers"))
    b = h.join(head, "result_id").withColumn("block", context.page_block(F.coalesce("filename", F.lit("")), F.col("page_num"), F.col("headers"), F.col("text"))).withColumn("question", F.concat(F.lit("q"), F.col("query_id")))
    out = context.prompt(b, "block", ["pos"])
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))


def alias_words(spark: SparkSession, d: str) -> DataFrame:
    """What names a file: acronyms, words of its name, words of its first page's summary."""
    return routing.aliases(_first_pages(spark, d), "summary_text")


def _first_pages(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.catalog import latest

    return latest(_t(spark, d, "search_results").where("filename <> ''"), ["filename"], [F.asc("result_id")])


def detect_source(spark: SparkSession, d: str) -> DataFrame:
    """The file that shares most words (two at least) with a question; the questions are summaries with an id divisible by 50."""
    q = _t(spark, d, "page_summaries").where("id % 50 = 0 and summary_text is not null").select(F.col("id").alias("query_id"), F.col("summary_text").alias("query"))
    return routing.detect(q, routing.alias_lists(_first_pages(spark, d), "summary_text"))


def same_doc_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether all sub-questions have the same best keyword hit; sub-questions here are the questions of a group of three."""
    top = lexical.bm25(_posts(spark, d), _questions(spark, d), 1).withColumnRenamed("key", "doc_id").join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return top.groupBy(F.floor(F.col("query_id") / 150).cast("bigint").alias("grp")).agg(((F.count("*") > 1) & (F.count_distinct("source") == 1)).alias("collapse"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with its label's first vector."""
    from leafmill.operators.catalog import latest

    e = _t(spark, d, "embeddings")
    first = latest(e, ["label"], [F.asc("vec_id")]).select("label", F.col("embedding").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


QUERIES = [
    bm25_topk, bm25_unicode_topk, bm25_corpus_stats, bm25_union_corpus, bm25_summary_prefix, bm25_stored, bm25_post_filter, vector_threshold, vector_filtered, rrf_lists, hybrid_search, quota_diversity, mmr_select, recency_bias, table_boost,
    roundrobin_interleave, dedup_prefix, multi_topic_merge, neighbour_expand, context_tokens, context_sources, budget_drop_buffers, budget_truncate, prompt_pages, alias_words, detect_source, same_doc_guard, cosine_pairs,
]

_DOCS = "docs AS (SELECT doc_id, coalesce(source, '') AS source, text, filename FROM documents WHERE length(text) > 0)"
_Q = "q AS (SELECT d.doc_id AS query_id, d.text AS query, e.embedding AS vector FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 50 = 0)"


def _bm25(tok: str, k: int) -> str:
    return f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tok}')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), st),
mean AS (SELECT avg(raw) AS mean_idf FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw, mean),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{tok}')) AS term FROM q) GROUP BY ALL),
bscored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bscored) WHERE rank <= {k} AND score > 0)"""


def _vec(name: str, k: int, where: str = "true") -> str:
    return f"""
{name} AS (SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.query_id, e.vec_id, round(list_cosine_similarity(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE q.vector IS NOT NULL AND {where})) WHERE rank <= {k})"""


_LISTS = f"""{_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 40)}, {_vec('v0', 40, 'e.vec_id % 2 = 0')}, {_vec('v1', 40, 'e.vec_id % 2 = 1')},
hits AS (
  SELECT query_id, source, doc_id, score, rank, list_no, is_vec FROM (
    SELECT query_id, vec_id AS doc_id, score, rank, 1 AS list_no, true AS is_vec FROM v0 UNION ALL SELECT query_id, vec_id, score, rank, 2, true FROM v1
    UNION ALL SELECT query_id, doc_id, score, rank, 3, false FROM bm) JOIN docs USING (doc_id)),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fl, fr) AS rrf_rank FROM (
    SELECT query_id, source, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list_no) AS fl, arg_min(rank, (list_no, rank)) AS fr, coalesce(max(score) FILTER (WHERE is_vec), 0.0) AS score, bool_or(is_vec) AS is_vec
    FROM hits GROUP BY query_id, source, doc_id))"""


def _quota(src: str, k: int, hard: float, soft: float) -> str:
    """The sequential rule as a recursion over the fused order."""
    return f"""
h AS (SELECT *, max(CASE WHEN score >= {soft} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc) = 1 AS ok FROM {src}),
n AS (SELECT query_id, greatest(count(DISTINCT doc) FILTER (WHERE score >= {soft}), 1) AS n FROM h GROUP BY ALL),
g0 AS (SELECT h.*, greatest(1, {k} // n) AS guarantee, greatest(2, {k} // n) AS cap, row_number() OVER (PARTITION BY query_id, doc ORDER BY rrf_rank) AS rd FROM h JOIN n USING (query_id)),
g AS (SELECT * EXCLUDE (rg) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_rank) AS rg FROM g0 WHERE ok AND rd <= guarantee) WHERE rg <= {k}),
gd AS (SELECT query_id, doc, count(*) AS c FROM g GROUP BY ALL),
gt AS (SELECT query_id, count(*) AS t FROM g GROUP BY ALL),
e AS (SELECT g0.*, row_number() OVER (PARTITION BY query_id, doc ORDER BY rrf_rank) AS re FROM g0 WHERE score >= {hard} AND NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = g0.query_id AND g.rrf_rank = g0.rrf_rank)),
e2 AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_id ORDER BY rrf_rank) AS rt FROM e LEFT JOIN gd USING (query_id, doc) WHERE re <= cap - coalesce(c, 0)),
picked AS (SELECT * EXCLUDE (re, rt, t), 2 AS pass FROM e2 LEFT JOIN gt USING (query_id) WHERE rt <= {k} - coalesce(t, 0) UNION ALL BY NAME SELECT *, 1 AS pass FROM g),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pass, rrf_rank) AS pos FROM picked)"""


_STORED = "stored AS (SELECT query_id, result_id, doc_id, page_num, round(score, 6) AS score, coalesce(summary_text, '') AS text, filename, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS pos FROM search_results)"
_EXPANDED = f"""{_STORED},
pg AS (SELECT doc_id, page_num, arg_min(raw_text, id) AS raw_text FROM pages WHERE raw_text IS NOT NULL GROUP BY ALL),
tot AS (SELECT doc_id, max(page_num) AS total FROM pg GROUP BY ALL),
slot AS (SELECT query_id, doc_id, unnest(range(greatest(1, page_num - 1), least(coalesce(total, 9999), page_num + 1) + 1)) AS slot, page_num, score, text FROM stored LEFT JOIN tot USING (doc_id) WHERE text <> ''),
ex AS (SELECT * FROM (SELECT s.query_id, s.doc_id, s.slot::INT AS page_num, s.is_direct, s.score, coalesce(pg.raw_text, s.own) AS raw_text FROM
  (SELECT query_id, doc_id, slot, bool_or(slot = page_num) AS is_direct, max(score) AS score, max(text) FILTER (WHERE slot = page_num) AS own FROM slot GROUP BY ALL) s
  LEFT JOIN pg ON pg.doc_id = s.doc_id AND pg.page_num = s.slot) WHERE raw_text IS NOT NULL)"""
_STOP = ", ".join(f"'{s}'" for s in T.ALIAS_STOPWORDS)
_ALIAS = rf"""
f AS (SELECT filename, arg_min(coalesce(summary_text, ''), result_id) AS t FROM search_results WHERE filename <> '' GROUP BY ALL),
al AS (SELECT DISTINCT filename, alias FROM (
  SELECT filename, lower(unnest(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))) AS alias FROM f
  UNION ALL SELECT * FROM (SELECT filename, unnest(regexp_extract_all(lower(regexp_replace(filename, '\.[^.]*$', '')), '[a-z]{{4,}}')) AS alias FROM f UNION ALL
    SELECT filename, unnest(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{5,}}'))) FROM f) WHERE alias NOT IN ({_STOP})))"""

SQL = {
    "bm25_topk": f"WITH {_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 10)} SELECT * FROM bm",
    "bm25_stored": f"WITH {_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 10)} SELECT * FROM bm",
    "bm25_unicode_topk": f"WITH {_DOCS}, {_Q}, {_bm25(r'[\p{L}\p{N}_]+', 10)} SELECT * FROM bm",
    "bm25_corpus_stats": f"WITH {_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 10)} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM st, mean",
    "bm25_union_corpus": "WITH " + _DOCS.replace("docs AS", "dd AS") + ", " + _Q.replace("docs d", "dd d") + f""", docs AS (SELECT 'p' || id AS doc_id, raw_text AS text FROM pages WHERE length(raw_text) > 0 UNION ALL SELECT 'c' || id, text FROM document_chunks WHERE length(text) > 0),
        {_bm25('[a-z0-9]+', 10)} SELECT query_id, doc_id AS key, score, rank FROM bm""",
    "bm25_summary_prefix": f"""WITH s AS (SELECT doc_id, page_num, arg_min(summary_text, id) AS s FROM page_summaries WHERE doc_id IS NOT NULL AND page_num IS NOT NULL AND summary_text IS NOT NULL GROUP BY ALL),
        docs AS (SELECT p.id AS doc_id, concat_ws(' ', CASE WHEN p.has_tables THEN nullif(s.s, '') END, p.raw_text) AS text FROM pages p LEFT JOIN s ON s.doc_id = p.doc_id AND s.page_num = p.page_num WHERE length(raw_text) > 0),
        q AS (SELECT term_id AS query_id, term AS query FROM glossary WHERE term IS NOT NULL), {_bm25('[a-z0-9]+', 5)} SELECT query_id, doc_id AS id, score, rank FROM bm""",
    "bm25_post_filter": f"WITH {_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 50)} SELECT query_id, doc_id, score, rank FROM bm JOIN docs USING (doc_id) JOIN (SELECT doc_id AS query_id, source AS wanted FROM docs) USING (query_id) WHERE source = wanted",
    "vector_topk": f"WITH {_DOCS}, {_Q}, {_vec('v', 10)} SELECT * FROM v",
    "vector_threshold": f"WITH {_DOCS}, {_Q}, {_vec('v', 10)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM v WHERE round(score, 4) >= 0.25",
    "vector_filtered": f"WITH {_DOCS}, {_Q}, {_vec('v', 5, 'e.label = 3')} SELECT * FROM v",
    "hash_embed": """WITH t AS (SELECT term_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 32 AS bucket FROM (SELECT term_id, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) AS w FROM glossary)),
        c AS (SELECT term_id, bucket, count(*) AS c FROM t GROUP BY ALL) SELECT term_id, bucket::BIGINT AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY term_id)), 6) AS value FROM c""",
    "rrf_lists": f"WITH {_LISTS} SELECT query_id, source, doc_id, rrf, rrf_rank, score, is_vec FROM fused",
    "hybrid_search": f"WITH {_LISTS}, fq AS (SELECT query_id, source AS doc, doc_id, rrf, rrf_rank, score FROM fused), {_quota('fq', TOP_K, HARD, SOFT)} SELECT query_id, doc, doc_id, rrf, rrf_rank, score, pos FROM final",
    "quota_diversity": f"WITH sr AS (SELECT query_id, doc_id AS doc, result_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS rrf_rank FROM search_results), {_quota('sr', 4, 0.5, 0.4)} SELECT query_id, doc, result_id, score, pos FROM final",
    "recency_bias": "SELECT id, round(0.5 + 0.01 * exp(-greatest(date_diff('day', ingested_at::DATE, DATE '2024-06-01'), 0) / 365.0), 6) AS score FROM doc_versions WHERE id IS NOT NULL AND ingested_at IS NOT NULL UNION ALL SELECT id, 0.5 FROM doc_versions WHERE id IS NOT NULL AND ingested_at IS NULL",
    "table_boost": """WITH s AS (SELECT result_id, round(score, 6) AS score, coalesce(summary_text, '') AS t, coalesce(has_tables, false) AS ht FROM search_results)
        SELECT result_id, CASE WHEN ht AND (contains(lower(t), 'compare') OR contains(lower(t), 'vs') OR contains(lower(t), 'versus') OR contains(lower(t), 'difference') OR contains(lower(t), 'higher than') OR contains(lower(t), 'lower than')
        OR len(regexp_extract_all(t, '\\b(?:19|20)\\d{2}\\b')) >= 2) THEN round(score + 0.02, 6) ELSE score END AS score FROM s""",
    "roundrobin_interleave": f"WITH {_STORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS r, min(pos) OVER (PARTITION BY query_id, doc_id) AS f FROM stored) SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY r, f) AS pos FROM r",
    "dedup_prefix": f"WITH {_STORED} SELECT query_id, min(result_id) AS result_id FROM stored GROUP BY query_id, substr(text, 1, 120)",
    "multi_topic_merge": f"""WITH {_STORED}, s AS (SELECT query_id // 3 AS query_id, query_id % 3 AS sub_idx, doc_id, page_num, score, pos FROM stored)
        SELECT query_id, doc_id, page_num, score, sub_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, page_num ORDER BY score DESC, sub_idx, pos) AS rn FROM s) WHERE rn = 1 AND score >= 0.25""",
    "neighbour_expand": f"WITH {_EXPANDED} SELECT query_id, doc_id, page_num, is_direct, score, length(raw_text) AS n_chars FROM ex",
    "context_tokens": f"WITH {_EXPANDED} SELECT query_id, (sum(length(raw_text)) // 4)::BIGINT AS tokens, count(*) AS pages FROM ex GROUP BY ALL",
    "context_sources": f"WITH {_STORED} SELECT query_id, doc_id, filename, page_num, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS rn FROM stored) WHERE rn = 1",
    "budget_drop_buffers": f"""WITH {_EXPANDED}, s AS (SELECT *, coalesce(sum(length(raw_text)) FILTER (WHERE is_direct) OVER (PARTITION BY query_id), 0) AS d,
        sum(length(raw_text)) OVER (PARTITION BY query_id, is_direct ORDER BY score DESC, doc_id DESC, page_num DESC ROWS UNBOUNDED PRECEDING) AS r FROM ex) SELECT query_id, doc_id, page_num, is_direct FROM s WHERE is_direct OR d + r < 4 * 5001""",
    "budget_truncate": f"""WITH RECURSIVE {_EXPANDED}, o AS (SELECT query_id, doc_id, page_num, length(raw_text) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id, page_num) AS i FROM ex WHERE is_direct),
        w AS (SELECT query_id, doc_id, page_num, i, 6000 AS before, CASE WHEN n <= 6000 THEN n ELSE 4000 END AS keep FROM o WHERE i = 1
          UNION ALL SELECT o.query_id, o.doc_id, o.page_num, o.i, w.before - w.keep, CASE WHEN o.n <= w.before - w.keep THEN o.n WHEN w.before - w.keep > 100 THEN least(4000, w.before - w.keep) ELSE 0 END FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1)
        SELECT query_id, doc_id, page_num, keep::BIGINT AS n_chars FROM w WHERE keep > 0 OR before > 100""",
    "prompt_pages": f"""WITH {_STORED}, b AS (SELECT s.query_id, s.pos, '=== ' || coalesce(s.filename, '') || ' — Page ' || s.page_num || CASE WHEN coalesce(r.headers, '') = '' THEN '' ELSE '  [' || replace(r.headers, ' | ', ' > ') || ']' END || ' ===' || chr(10) || s.text || chr(10) || '=== end ===' AS block FROM stored s JOIN search_results r USING (result_id) WHERE s.text <> ''),
        p AS (SELECT query_id, '=== documents ===' || chr(10) || string_agg(block, chr(10) ORDER BY pos) || chr(10) || '=== end of documents ===' || chr(10) || 'Question: q' || query_id AS prompt FROM b GROUP BY query_id) SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p""",
    "alias_words": f"WITH {_ALIAS} SELECT filename, alias FROM al",
    "detect_source": rf"""WITH {_ALIAS}, qq AS (SELECT id AS query_id, summary_text AS q FROM page_summaries WHERE id % 50 = 0 AND summary_text IS NOT NULL),
        qw AS (SELECT DISTINCT query_id, alias FROM (SELECT query_id, lower(unnest(list_filter(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))) AS alias FROM qq UNION ALL SELECT query_id, unnest(regexp_extract_all(lower(q), '[a-z]{{4,}}')) FROM qq)),
        s AS (SELECT query_id, filename, count(*) AS shared FROM qw JOIN al USING (alias) GROUP BY ALL HAVING shared >= 2) SELECT query_id, filename, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, filename) AS rn FROM s) WHERE rn = 1""",
    "same_doc_guard": f"WITH {_DOCS}, {_Q}, {_bm25('[a-z0-9]+', 10)} SELECT query_id // 150 AS grp, count(*) > 1 AND count(DISTINCT source) = 1 AS collapse FROM bm JOIN docs USING (doc_id) WHERE rank = 1 GROUP BY ALL",
    "cosine_pairs": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS fe FROM embeddings GROUP BY ALL) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], fe::DOUBLE[]), 6) AS cosine FROM embeddings JOIN f USING (label)",
}
