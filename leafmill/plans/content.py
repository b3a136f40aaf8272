"""Text, table and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import tables as B
from leafmill.functions import text as T
from leafmill.operators import chunking


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "session_messages").where("content is not null").select("id", "content")


def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.intent(F.col("content")).alias("intent"), F.array_join(T.intent_signals(F.col("content")), ",").alias("signals"))


def multi_topic_flag(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.is_multi_topic(F.col("content")).alias("multi"))


def expand_query(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.md5(T.expand_query(F.col("content"))).alias("expanded_md5"))


def fallback_split(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.posexplode(T.fallback_split(F.col("content"))).alias("part", "text")).select("id", F.col("part").cast("bigint").alias("part"), F.md5("text").alias("text_md5"))


def decompose_clean(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").where("raw_text is not null")
    return p.select("id", F.posexplode(T.decomposed(F.col("raw_text"), F.lit("?"))).alias("part", "text")).select("id", F.col("part").cast("bigint").alias("part"), F.md5("text").alias("text_md5"))


def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.md5(T.cache_key(F.col("content"))).alias("key_md5"))


def think_strip(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.length(T.strip_think(F.col("content"))).cast("bigint").alias("n_chars"))


def summary_clean(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "page_summaries").where("summary_text is not null")
    return s.select("id", F.md5(T.clean_summary(F.col("summary_text"), 120)).alias("text_md5"))


def summary_gate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("id", F.md5(T.summary_gate(F.col("raw_text"))).alias("input_md5"))


def embeddable_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries worth embedding: not blank, no marker."""
    s = _t(spark, d, "page_summaries")
    return s.where("trim(summary_text) not in ('', '[Empty page]', '[Summarization failed]')").select("id", "doc_id", "page_num")


def page_class(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").where("raw_text is not null")
    return p.select("id", T.page_class(T.word_count(F.col("raw_text")), F.coalesce("has_tables", F.lit(False)), F.col("raw_text")).alias("class"))


def table_signal(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").where("raw_text is not null").select("id", T.looks_like_table(F.col("raw_text")).alias("is_table"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"), F.size(T.ascii_tokens(F.col("text"))).cast("bigint").alias("ascii"), F.size(T.unicode_tokens(F.col("text"))).cast("bigint").alias("uni"))


def source_types(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "doc_versions").where("filename is not null")
    return v.select("id", F.coalesce(T.source_type(F.col("filename")), F.lit("unsupported")).alias("source_type"))


def url_page_id(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "doc_versions").select("id", F.concat(F.lit("https://wiki.example.org/spaces/A/pages/"), F.regexp_extract(F.coalesce("source_id", F.lit("")), r"(\d+)", 1), F.lit("/x?pageId=7")).alias("url"))
    return v.select("id", T.wiki_page_id(F.col("url")).alias("page_id"), T.base_url(F.col("url")).alias("base"))


def significance_marks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").where("raw_text is not null").select("id", T.significance_marks(F.col("raw_text")).alias("marks")).where("marks <> ''")


def miss_detect(spark: SparkSession, d: str) -> DataFrame:
    """Each message as an answer to the one before it in its session, in the context of the page summary with its id."""
    m = _t(spark, d, "session_messages").where("content is not null and session_id is not null")
    asked = m.withColumn("question", F.lag("content").over(Window.partitionBy("session_id").orderBy("id"))).where("question is not null")
    x = asked.join(_t(spark, d, "page_summaries").select("id", "summary_text"), "id", "left")
    tokens = T.missing_tokens(F.col("question"), F.col("content"), F.col("summary_text"))
    return x.select("id", T.has_miss(F.col("content")).alias("says_so"), F.array_join(tokens, ",").alias("missing"), F.md5(F.array_join(T.missing_tokens(F.col("question"), F.lit("geen informatie"), F.col("summary_text")), ",")).alias("if_it_did"))


def json_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headings encoded as JSON and read back."""
    p = _t(spark, d, "pages").where("headers is not null").withColumn("j", F.to_json("headers"))
    return p.select("id", F.posexplode(F.from_json("j", "array<string>")).alias("pos", "header")).select("id", F.col("pos").cast("bigint").alias("pos"), "header")


def distinct_headers(spark: SparkSession, d: str) -> DataFrame:
    """The first ten distinct headings of a page."""
    p = _t(spark, d, "pages").where("headers is not null")
    return p.select("id", F.array_join(F.slice(F.array_distinct("headers"), 1, 10), "|").alias("headers"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    h = _t(spark, d, "search_results")
    return h.select("result_id", F.coalesce(F.nullif("filename", F.lit("")), F.lit("unknown")).alias("filename"), F.coalesce(F.nullif("source_type", F.lit("")), F.lit("document")).alias("source"), F.round("score", 4).alias("score"), F.substring(F.coalesce("summary_text", F.lit("")), 1, 300).alias("excerpt"))


def embed_prefix(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "document_chunks").where("text is not null")
    text = F.concat(F.lit("[Document: "), "doc_id", F.lit(" | Page: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(" | Type: "), F.coalesce("block_type", F.lit("text")), F.lit("]\n"), "text")
    return c.select("id", F.md5(text).alias("text_md5"))


def flatten_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    heads = F.array(*(F.lit(c) for c in ("key", "name", "", "size")))
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")))
    return p.select("p_partkey", B.flatten_row(heads, cells).alias("line"))


def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "supplier")
    cells = F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    return n.select("s_suppkey", B.markdown_row(cells, F.lit(4)).alias("line"), B.injected_row(F.array(F.lit("key"), F.lit(""), F.lit("nation")), cells).alias("injected"))


def sheet_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    heads = F.array(*(F.lit(f"col{i}") for i in range(10)))
    return c.select("c_mktsegment", B.sheet_summary(F.col("c_mktsegment"), heads, F.col("n")).alias("summary"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.sentence_chunks(_t(spark, d, "documents"), "doc_id", "text", 120, 20)
    return c.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_t(spark, d, "documents"), "doc_id", "text", chunking.window_chunks).select("doc_id", "chunk_no", "chunk")


def table_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_t(spark, d, "pages").where("has_tables"), "id", "raw_text", chunking.table_chunks).select("id", "chunk_no", "chunk")


def inline_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_t(spark, d, "pages"), "id", "raw_text", chunking.inline_chunks)


def line_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_t(spark, d, "documents"), "doc_id", "text", chunking.line_pages).select("doc_id", "chunk_no", "chunk")


def section_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page with the running number of headings and the heading that holds."""
    g = _t(spark, d, "glossary").where("term is not null").select(F.col("term").alias("line"), F.lit(1).alias("h")).distinct()
    lines = _t(spark, d, "pages").where("raw_text is not null").select("id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("id").orderBy("pos")
    x = lines.join(F.broadcast(g), "line", "left").withColumn("section", F.sum(F.coalesce("h", F.lit(0))).over(w)).withColumn("heading", F.last(F.when(F.col("h") == 1, F.col("line")), True).over(w))
    return x.select("id", F.col("pos").cast("bigint").alias("pos"), "section", "heading")


QUERIES = [
    intent_classify, multi_topic_flag, expand_query, fallback_split, decompose_clean, cache_key, think_strip, summary_clean, summary_gate, embeddable_summaries, page_class, table_signal, word_counts, source_types,
    url_page_id, significance_marks, miss_detect, json_headers, distinct_headers, citations, embed_prefix, flatten_rows, markdown_rows, sheet_summary, sentence_chunks, window_chunks, table_row_chunks, inline_chunks, line_pages, section_ids,
]


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_L = "lower(content)"
_SPLIT = "\n".join(f"WHEN position(' {c} ' IN {_L}) > 0 AND trim(substr(content, 1, position(' {c} ' IN {_L}) - 1)) <> '' AND trim(substr(content, position(' {c} ' IN {_L}) + {len(c) + 2})) <> '' THEN [trim(substr(content, 1, position(' {c} ' IN {_L}) - 1)), trim(substr(content, position(' {c} ' IN {_L}) + {len(c) + 2}))]" for c in T.CONJUNCTIONS)
_LINES = r"regexp_split_to_array(raw_text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_TABLE = rf"len(list_filter({_LINES}, lambda x: regexp_matches(x, '^.*\|.*\|', 's') OR regexp_matches(x, '\t.*\t', 's') OR regexp_matches(x, '(?:[ ]{{2,}}[^\s]{{1,40}}){{2,}}'))) > 0"
_SIG = lambda words: "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({_L}, w))"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"

SQL = {
    "intent_classify": f"""WITH c AS (SELECT id, {_SIG(T.COMPARISON)} AS c, {_SIG(T.AGGREGATION)} AS a, {_SIG(T.MULTI_TOPIC)} AS m, length(content) - length(replace(content, '?', '')) > 1 AS q FROM session_messages WHERE content IS NOT NULL)
        SELECT id, CASE WHEN len(c) > 0 THEN 'comparison' WHEN len(a) > 0 THEN 'aggregation' WHEN len(m) > 0 OR q THEN 'multi-topic' ELSE 'single' END AS intent,
          coalesce(array_to_string(CASE WHEN len(c) > 0 THEN c WHEN len(a) > 0 THEN a WHEN q THEN list_append(m, 'multiple-questions') ELSE m END, ','), '') AS signals FROM c""",
    "multi_topic_flag": r"SELECT id, length(content) - length(replace(content, '?', '')) >= 2 OR (length(content) > 100 AND len(regexp_extract_all(lower(content), '\band\b')) >= 3) AS multi FROM session_messages WHERE content IS NOT NULL",
    "expand_query": f"SELECT id, md5(CASE WHEN {_WORDS.format('content')} < 8 THEN 'Provide detailed information about ' || content || '. Include definitions, context and details.' ELSE content END) AS expanded_md5 FROM session_messages WHERE content IS NOT NULL",
    "fallback_split": f"WITH p AS (SELECT id, CASE {_SPLIT} ELSE [content] END AS parts FROM session_messages WHERE content IS NOT NULL) SELECT id, unnest(range(len(parts))) AS part, md5(unnest(parts)) AS text_md5 FROM p",
    "decompose_clean": r"""WITH l AS (SELECT id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:\d+[.)]|[-*•])\s*', ''), ' ')), lambda x: length(x) > 10) AS l FROM pages WHERE raw_text IS NOT NULL),
        p AS (SELECT id, CASE WHEN len(l) BETWEEN 2 AND 6 THEN l ELSE ['?'] END AS parts FROM l) SELECT id, unnest(range(len(parts))) AS part, md5(unnest(parts)) AS text_md5 FROM p""",
    "cache_key": r"SELECT id, md5(trim(regexp_replace(regexp_replace(lower(trim(content)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS key_md5 FROM session_messages WHERE content IS NOT NULL",
    "think_strip": r"SELECT id, length(regexp_replace(content, '<think>.*?</think>\s*', '', 'gs')) AS n_chars FROM session_messages WHERE content IS NOT NULL",
    "summary_clean": r"""WITH c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(summary_text, '={2,}[^=\n]*={2,}', '', 'g'), '-{3,}[^-\n]*-{3,}', '', 'g'), '(?m)^\s*Page \d+\s*$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM page_summaries WHERE summary_text IS NOT NULL)
        SELECT id, md5(CASE WHEN length(t) <= 120 THEN t ELSE coalesce(nullif(regexp_replace(substr(t, 1, 120), '\s+[^\s]*$', ''), ''), substr(t, 1, 120)) || '…' END) AS text_md5 FROM c""",
    "summary_gate": "SELECT id, md5(CASE WHEN length(trim(coalesce(raw_text, ''), ' ')) < 50 THEN '[Empty page]' ELSE substr(raw_text, 1, 6000) END) AS input_md5 FROM pages",
    "embeddable_summaries": "SELECT id, doc_id, page_num FROM page_summaries WHERE trim(summary_text) NOT IN ('', '[Empty page]', '[Summarization failed]')",
    "page_class": f"SELECT id, CASE WHEN {_TABLE} THEN 'TABLE' WHEN {_WORDS.format('raw_text')} >= 50 THEN 'TEXT_RICH' WHEN {_WORDS.format('raw_text')} < 20 THEN CASE WHEN coalesce(has_tables, false) THEN 'IMAGE_ONLY' ELSE 'TEXT_RICH' END WHEN coalesce(has_tables, false) THEN 'MIXED' ELSE 'TEXT_RICH' END AS class FROM pages WHERE raw_text IS NOT NULL",
    "table_signal": f"SELECT id, {_TABLE} AS is_table FROM pages WHERE raw_text IS NOT NULL",
    "word_counts": rf"SELECT doc_id, {_WORDS.format('text')} AS words, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ascii, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS uni FROM documents WHERE text IS NOT NULL",
    "source_types": r"SELECT id, CASE lower(regexp_extract(filename, '\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'pptx' WHEN 'xlsx' THEN 'xlsx' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' ELSE 'unsupported' END AS source_type FROM doc_versions WHERE filename IS NOT NULL",
    "url_page_id": r"SELECT id, coalesce(nullif(regexp_extract(coalesce(source_id, ''), '(\d+)', 1), ''), '7') AS page_id, 'https://wiki.example.org' AS base FROM doc_versions",
    "significance_marks": "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '[*†‡§¶^]'))), '') AS marks FROM pages WHERE regexp_matches(raw_text, '[*†‡§¶^]')",
    "miss_detect": rf"""WITH m AS (SELECT id, content, lag(content) OVER (PARTITION BY session_id ORDER BY id) AS question FROM session_messages WHERE content IS NOT NULL AND session_id IS NOT NULL),
        x AS (SELECT m.id, {_any("lower(content)", T.MISS_PHRASES)} AS says_so, list_sort(list_filter(list_distinct(list_filter(regexp_extract_all(question, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{3,}}|[A-Za-z]{{4,}}'))),
          lambda w: NOT contains(lower(coalesce(s.summary_text, '')), lower(w)))) AS t FROM m LEFT JOIN page_summaries s ON s.id = m.id WHERE question IS NOT NULL)
        SELECT id, says_so, CASE WHEN says_so THEN coalesce(array_to_string(t, ','), '') ELSE '' END AS missing, md5(coalesce(array_to_string(t, ','), '')) AS if_it_did FROM x""",
    "json_headers": "SELECT id, unnest(range(len(headers))) AS pos, unnest(headers) AS header FROM pages WHERE headers IS NOT NULL",
    "distinct_headers": "WITH u AS (SELECT id, unnest(headers) AS h, unnest(range(len(headers))) AS p FROM pages), f AS (SELECT id, h, min(p) AS p FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM f) SELECT p.id, coalesce(string_agg(h, '|' ORDER BY rn), '') AS headers FROM pages p LEFT JOIN r ON r.id = p.id AND rn <= 10 WHERE p.headers IS NOT NULL GROUP BY p.id",
    "citations": "SELECT result_id, coalesce(nullif(filename, ''), 'unknown') AS filename, coalesce(nullif(source_type, ''), 'document') AS source, round(score, 4) AS score, substr(coalesce(summary_text, ''), 1, 300) AS excerpt FROM search_results",
    "embed_prefix": "SELECT id, md5('[Document: ' || doc_id || ' | Page: ' || coalesce(page::VARCHAR, '') || ' | Type: ' || coalesce(block_type, 'text') || ']' || chr(10) || text) AS text_md5 FROM document_chunks WHERE text IS NOT NULL",
    "flatten_rows": "SELECT p_partkey, 'key: ' || p_partkey || ' | name: ' || p_name || ' | ' || p_brand || CASE WHEN p_size % 5 <> 0 THEN ' | size: ' || p_size ELSE '' END AS line FROM part",
    "markdown_rows": "SELECT s_suppkey, '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |  |' AS line, '| key: ' || s_suppkey || ' | ' || s_name || ' | nation: ' || s_nationkey || ' |' AS injected FROM supplier",
    "sheet_summary": "SELECT c_mktsegment, 'Sheet: ' || c_mktsegment || '. Columns: col0, col1, col2, col3, col4, col5, col6, col7 (+2 more). Rows: ' || count(*) || '.' AS summary FROM customer GROUP BY c_mktsegment",
    "section_ids": """WITH l AS (SELECT id, unnest(range(len(string_split(raw_text, chr(10))))) AS pos, unnest(string_split(raw_text, chr(10))) AS line FROM pages WHERE raw_text IS NOT NULL),
        h AS (SELECT l.*, g.term IS NOT NULL AS h FROM l LEFT JOIN (SELECT DISTINCT term FROM glossary) g ON g.term = l.line)
        SELECT id, pos, (count(*) FILTER (WHERE h) OVER w)::BIGINT AS section, last_value(CASE WHEN h THEN line END IGNORE NULLS) OVER w AS heading FROM h WINDOW w AS (PARTITION BY id ORDER BY pos)""",
}

#: White space as the texts' ends are trimmed of it.
_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
_strip = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_greedy = """f AS (SELECT {k}, 0 AS i, {first}::BIGINT AS used, 0 AS grp, 0 AS held FROM d GROUP BY ALL
    UNION ALL SELECT f.{k}, f.i + 1, CASE WHEN held > 0 AND used + n > {most} THEN {first} + n ELSE used + n END, grp + CASE WHEN held > 0 AND used + n > {most} THEN 1 ELSE 0 END, CASE WHEN held > 0 AND used + n > {most} THEN 1 ELSE held + 1 END FROM f JOIN l ON l.{k} = f.{k} AND l.i = f.i + 1)"""
#: Greedy packing as a recursion over lines; the queries' rules use prefix sums.
SQL |= {
    "sentence_chunks": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, {_TABLE.replace('raw_text', 'text')} AS tab, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w,
          list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.?!])\s+', '\1' || chr(57344), 'g'), chr(57344) || '|\n\n+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents WHERE regexp_matches(text, '[^\s]')),
        n AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, len(list_filter(regexp_split_to_array(unnest(s), '\s+'), lambda w: w <> '')) AS n FROM d WHERE NOT tab),
        f AS (SELECT doc_id, 0 AS i, 0::BIGINT AS start, 0::BIGINT AS pos, NULL::BIGINT AS a, NULL::BIGINT AS b FROM d WHERE NOT tab
          UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN pos > start AND pos - start + n > 120 THEN greatest(start, pos - 20) ELSE start END, pos + n, CASE WHEN pos > start AND pos - start + n > 120 THEN start END, CASE WHEN pos > start AND pos - start + n > 120 THEN pos END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
        c AS (SELECT doc_id, i, a, b FROM f WHERE a IS NOT NULL UNION ALL SELECT doc_id, i + 1, start, pos FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE pos > start)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, md5(array_to_string(w[a + 1 : b], ' ')) AS chunk_md5 FROM c JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, md5(trim(text, ' ')) FROM d WHERE tab""",
    "line_pages": f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE {_strip('text')} <> ''), l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line, length(unnest(string_split(text, chr(10)))) + 1 AS n FROM d),
        {_greedy.format(k='doc_id', first=0, most=5000)}, g AS (SELECT f.doc_id, grp, string_agg(line, chr(10) ORDER BY f.i) AS chunk, max(grp) OVER (PARTITION BY f.doc_id) AS last FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY f.doc_id, grp)
        SELECT doc_id, grp::BIGINT AS chunk_no, chunk FROM g WHERE grp < last OR {_strip('chunk')} <> ''""",
    "table_row_chunks": rf"""WITH RECURSIVE t AS (SELECT id, {_strip('raw_text')} AS t FROM pages WHERE has_tables AND {_strip('raw_text')} <> ''), x AS (SELECT id, string_split(t, chr(10)) AS x FROM t WHERE length(t) > 900),
        h AS (SELECT id, x, CASE WHEN regexp_matches(coalesce(x[2], ''), '^\s*\|?\s*:?-{{2,}}') THEN 2 ELSE 1 END AS h FROM x),
        d AS (SELECT id, x[h + 1 :] AS rows, array_to_string(x[: h], chr(10)) AS head, len(array_to_string(x[: h], chr(10))) + 1 AS first FROM h),
        l AS (SELECT id, unnest(range(1, len(rows) + 1)) AS i, unnest(rows) AS line, length(unnest(rows)) + 1 AS n FROM d), {_greedy.format(k='id', first='d.first', most=900).replace('d.first::BIGINT', 'first::BIGINT', 1).replace('FROM f JOIN l ON', 'FROM f JOIN d ON d.id = f.id JOIN l ON')}
        SELECT id, 0::BIGINT AS chunk_no, t AS chunk FROM t WHERE length(t) <= 900 UNION ALL SELECT id, 0, head FROM d WHERE len(rows) = 0
        UNION ALL SELECT f.id, grp, any_value(d.head) || chr(10) || string_agg(line, chr(10) ORDER BY f.i) FROM f JOIN l ON l.id = f.id AND l.i = f.i JOIN d ON d.id = f.id GROUP BY f.id, grp""",
    "window_chunks": rf"""WITH RECURSIVE d AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE {_strip('text')} <> ''),
        w AS (SELECT doc_id, t, 0 AS i, 0::BIGINT AS start, 0::BIGINT AS stop FROM d
          UNION ALL SELECT doc_id, t, i + 1, CASE WHEN i = 0 THEN 0 ELSE nxt END, CASE WHEN lim >= length(t) THEN length(t)
            WHEN regexp_matches(seg, '

') THEN base + length(regexp_extract(seg, '(?s)^(.*)

', 1)) + 2 WHEN regexp_matches(seg, '\.
') THEN base + length(regexp_extract(seg, '(?s)^(.*)\.
', 1)) + 2 WHEN contains(seg, '. ') THEN base + length(regexp_extract(seg, '(?s)^(.*)\. ', 1)) + 2
            WHEN contains(seg, '? ') THEN base + length(regexp_extract(seg, '(?s)^(.*)\? ', 1)) + 2 WHEN contains(seg, '! ') THEN base + length(regexp_extract(seg, '(?s)^(.*)! ', 1)) + 2 WHEN contains(seg, chr(10)) THEN base + length(regexp_extract(seg, '(?s)^(.*)
', 1)) + 1 ELSE lim END
          FROM (SELECT *, least(nxt + 900, length(t)) AS lim, nxt + 180 AS base, substr(t, nxt + 181, least(nxt + 900, length(t)) - nxt - 180) AS seg FROM (SELECT *, CASE WHEN i = 0 THEN 0 WHEN stop - 180 > start THEN stop - 180 ELSE start + 450 END AS nxt FROM w)) WHERE nxt < length(t)),
        c AS (SELECT doc_id, i, {_strip('substr(t, start + 1, stop - start)')} AS chunk FROM w WHERE i > 0)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, chunk FROM c WHERE chunk <> ''""",
}
