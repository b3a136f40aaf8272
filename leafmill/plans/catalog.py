"""Catalogue, session, statistics, crawl and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import catalog, sessions, stats
from leafmill.sources import crawl
from leafmill.streaming import ingest

AS_OF = "2023-05-01"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sha_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Texts by content hash: the least document of each and how many there are."""
    x = _t(spark, d, "documents").where("text is not null").select("doc_id", catalog.content_hash(F.col("text")).alias("sha"))
    return x.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("id", catalog.point_id(F.col("doc_id"), F.col("page_num")).alias("point_id"))


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chunk_records(_t(spark, d, "document_chunks")).withColumn("text", F.md5("text"))


def insert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the catalogue lacks, entered with their first state."""
    v = _t(spark, d, "doc_versions").select("id", "filename", "hash", "status")
    new = _t(spark, d, "documents").select(F.concat(F.lit("new-"), "doc_id").alias("id"), "filename", "hash")
    return catalog.inserted(v, new, {"status": F.lit("processing"), "filename": F.lit("unknown")}).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("filename") == "unknown").alias("unknown"), F.count_distinct("hash").alias("hashes"))


def status_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished versions become indexed or failed by their id; the time is set for the indexed ones."""
    v = _t(spark, d, "doc_versions").select("id", "status", F.lit(None).cast("string").alias("indexed_at"))
    changes = v.where("status is null or status not in ('indexed', 'failed')").select("id", F.when(F.substring(F.md5("id"), 1, 1) < "8", "indexed").otherwise("failed").alias("status"))
    return catalog.with_status(v, changes, F.lit(AS_OF))


def clear_all(spark: SparkSession, d: str) -> DataFrame:
    empty, gone = catalog.cleared(_t(spark, d, "document_chunks"))
    return gone.crossJoin(empty.agg(F.count("*").alias("left")))


def activity_append(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 of a log after more came in."""
    j = _jobs(spark, d).select("event_id", "ts", "outcome")
    return catalog.appended(j.where("event_id % 3 <> 0"), j.where("event_id % 3 = 0"), 50, [F.desc("ts"), F.desc("event_id")]).select("event_id", "outcome")


def message_append(spark: SparkSession, d: str) -> DataFrame:
    """Glossary terms as new messages behind the stored ones."""
    new = _t(spark, d, "glossary").select(F.col("term").alias("content"), "term_id")
    return catalog.numbered_after(_t(spark, d, "session_messages"), new, ["term_id"]).select("id", "content")


def reindex_all(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.vector import hash_embed

    r = catalog.reindexed(_t(spark, d, "page_summaries"), lambda c: hash_embed(c, 16))
    return r.select("id", "point_id", "embedded", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """The indexed versions, oldest first and newest first."""
    from pyspark.sql import Window

    v = _t(spark, d, "doc_versions").where("status = 'indexed'")
    return v.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_first("ingested_at"), "id")).alias("oldest"), F.row_number().over(Window.orderBy(F.desc_nulls_last("ingested_at"), "id")).alias("newest"))


def exists_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which versions have a chunk at all."""
    c = _t(spark, d, "document_chunks").select(F.col("doc_id").alias("id"))
    return _t(spark, d, "doc_versions").select("id").join(c, "id", "left_semi")


def session_prune_count(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "sessions")
    return sessions.stale(s, F.lit(AS_OF).cast("timestamp_ntz"), 30).agg(F.count("*").alias("removed"))


def role_check(spark: SparkSession, d: str) -> DataFrame:
    """What a session asks for that is not known: set minus, as for unknown permissions."""
    m = _t(spark, d, "session_messages").where("session_id is not null").groupBy("session_id").agg(F.collect_set(F.lower("role")).alias("r"))
    x = F.array_sort(F.array_except("r", F.array(*(F.lit(v) for v in ("user", "assistant", "system", "human", "bot", "ai")))))
    return m.where(F.size(x) > 0).select("session_id", F.array_join(x, ",").alias("unknown"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Both generations together: chunks and documents of each, summed; active keys are users seen in the last day of events."""
    one = _t(spark, d, "document_chunks").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))
    two = _t(spark, d, "page_summaries").agg(F.count_if(F.expr("embedded")).alias("chunks"), F.count_distinct("doc_id").alias("documents"))
    e = _t(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    active = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).agg(F.count_if(F.col("last") > F.col("now") - F.expr("interval 1 day")).alias("active"))
    return one.unionByName(two).agg(F.sum("chunks").alias("chunks"), F.sum("documents").alias("documents")).crossJoin(active)


def model_list(spark: SparkSession, d: str) -> DataFrame:
    """Names without one and what is derived from it, the default first, the rest in order; the brands of parts stand for models."""
    from pyspark.sql import Window

    m = _t(spark, d, "part").select(F.col("p_brand").alias("name")).distinct().where("name <> 'Brand#11' and not startswith(name, 'Brand#11:')")
    return m.select("name", F.row_number().over(Window.orderBy(F.desc(F.col("name") == "Brand#32"), "name")).alias("pos"))


def latest_by_name(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "doc_versions").where("status = 'indexed' and filename is not null")
    return catalog.latest(v, ["filename"], [F.desc_nulls_last("ingested_at"), F.desc("id")]).select("filename", "id")


def latest_by_source(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "doc_versions").where("source_id is not null")
    return catalog.latest(v, ["source_id"], [F.desc_nulls_last("ingested_at"), F.desc("id")]).select("source_id", "id")


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("doc_id", "page_num", "id").where("doc_id is not null and page_num is not null")
    return catalog.latest(p, ["doc_id", "page_num"], [F.desc("id")])


def status_patch(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "doc_versions").select("id", "filename", "status")
    changes = v.where("status is null").select("id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("filename"))
    return catalog.patch(v, changes, "id")


def embedded_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flags of one half of the documents are reset, the others kept, nulls being false."""
    s = _t(spark, d, "page_summaries")
    return s.select("id", F.when(F.substring(F.md5("doc_id"), 1, 1) < "8", False).otherwise(F.coalesce("embedded", F.lit(False))).alias("embedded"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    failed = _t(spark, d, "doc_versions").where("status = 'failed'").select(F.col("id").alias("doc_id"))
    left = catalog.cascade(_t(spark, d, "pages"), failed)
    return left.groupBy("doc_id").agg(F.count("*").alias("pages"))


def delete_by_filename(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "documents")
    gone = x.where("filename in ('scan.pdf', 'notes.pdf')")
    return gone.agg(F.count("*").alias("deleted")).crossJoin(x.where("filename is null or filename not in ('scan.pdf', 'notes.pdf')").agg(F.count("*").alias("kept")))


def swap_after(spark: SparkSession, d: str) -> DataFrame:
    return catalog.replaced(_t(spark, d, "doc_versions").where("ingested_at is not null")).select("id")


def ingest_verdict(spark: SparkSession, d: str) -> DataFrame:
    new = _t(spark, d, "doc_versions").where("status <> 'indexed' or status is null").select("id", "filename", "hash")
    return catalog.verdict(new, _t(spark, d, "doc_versions")).select("id", "verdict")


def summary_page_join(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with their page's headings and table flag; none for pages that are not stored."""
    p = catalog.latest(_t(spark, d, "pages"), ["doc_id", "page_num"], [F.asc("id")]).select("doc_id", "page_num", "headers", "has_tables")
    s = _t(spark, d, "page_summaries").select("id", "doc_id", "page_num").join(p, ["doc_id", "page_num"], "left")
    return s.select("id", F.when(F.col("headers").isNull(), 0).otherwise(F.size("headers")).cast("bigint").alias("n_headers"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"))


def page_count(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "document_chunks").groupBy("doc_id").agg(F.max("page").alias("p"))
    return _t(spark, d, "doc_versions").select(F.col("id").alias("doc_id")).join(c, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(0)).alias("page_count"))


def chunks_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document numbered in order of page and index."""
    from pyspark.sql import Window

    c = _t(spark, d, "document_chunks")
    return c.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("page"), F.asc_nulls_first("chunk_index"), "id"))).select("id", "nth")


def distinct_files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("filename is not null").select("filename").distinct()


def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))


def sources_by_file(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each file among a question's hits."""
    h = _t(spark, d, "search_results").select("query_id", "filename", "page_num").distinct()
    return h.groupBy("query_id", "filename").agg(F.array_join(F.sort_array(F.collect_list("page_num")), ",").alias("pages"))


def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    c = stats.dashboard(_t(spark, d, "document_chunks"), "block_type", "table")
    return c.crossJoin(_t(spark, d, "doc_versions").agg(F.count_if(F.expr("status = 'indexed'")).alias("indexed"))).crossJoin(_t(spark, d, "page_summaries").agg(F.count_if(F.expr("embedded")).alias("vectors")))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("outcome", F.when(F.col("event_id") % 5 == 0, "skipped").when(F.col("event_id") % 7 == 0, "failed").otherwise("success"))


def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.job_summary(_jobs(spark, d))


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "outcome")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.cache_stats(_t(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id"))


def quality_label(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality(_t(spark, d, "search_results").select("doc_id", (F.round("score", 6) >= 0.5).alias("hit")))


def header_detect(spark: SparkSession, d: str) -> DataFrame:
    """Larger spans; a message's length stands for the type size, its session for the page."""
    m = _t(spark, d, "session_messages").where("session_id is not null")
    return stats.headers_by_size(m.select(F.col("session_id").alias("page"), F.coalesce(F.length("content"), F.lit(0)).alias("size"), F.coalesce("role", F.lit("")).alias("text"), F.col("id").alias("pos"))).select("page", "text", "pos", "nth")


def rotation_flag(spark: SparkSession, d: str) -> DataFrame:
    """Rotated pages; a chunk stands for a line, a table for a rotated one."""
    c = _t(spark, d, "document_chunks").select(F.col("doc_id").alias("page"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), (F.coalesce("block_type", F.lit("")) == "table").alias("is_rotated"))
    return stats.rotated(c)


def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    return sessions.touched(_t(spark, d, "sessions"), _t(spark, d, "session_messages"))


def session_recent(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recent(_t(spark, d, "session_messages").where("session_id is not null"), 6).select("session_id", "id", "pos")


def session_prune(spark: SparkSession, d: str) -> DataFrame:
    _, m = sessions.pruned(_t(spark, d, "sessions"), _t(spark, d, "session_messages"), F.lit(AS_OF).cast("timestamp_ntz"), 30)
    return m.groupBy("session_id").agg(F.count("*").alias("messages"))


def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a tree of wiki pages: each page's parent is half its number."""
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 4).cast("bigint").alias("parent")).where("parent >= 1")
    return crawl.below(x, spark.createDataFrame([(2,)], "node bigint")).select("node", F.col("level").cast("bigint").alias("level"))


def stream_dedup_batch(spark: SparkSession, d: str) -> DataFrame:
    """Contents that a stream of documents lets through, each once; rows without a hash equal nothing and all pass."""
    return ingest.to_table(ingest.new_content(ingest.read_files(spark, f"{d}/documents.parquet").select("hash"))).select("hash")


def stream_dedup_within(spark: SparkSession, d: str) -> DataFrame:
    """The same with state of bounded time."""
    s = ingest.read_files(spark, f"{d}/documents.parquet").select("hash", "ingested_at")
    return ingest.to_table(ingest.new_content_within(s, "ingested_at", "20000 days").select("hash"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that begin every six hours."""
    out = ingest.to_table(ingest.windowed(ingest.read_files(spark, f"{d}/events.parquet").select("ts", "event_type", "value"), "24 hours", "1 day", "6 hours"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.to_table(ingest.visits(ingest.read_files(spark, f"{d}/events.parquet").select("ts", "user_id")))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of events from a stream; the last day is still open to late rows."""
    out = ingest.to_table(ingest.windowed(ingest.read_files(spark, f"{d}/events.parquet").select("ts", "event_type", "value")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = [
    sha_dedup, point_ids, latest_by_name, latest_by_source, upsert_last_wins, status_patch, embedded_flags, cascade_delete, delete_by_filename, swap_after, ingest_verdict, summary_page_join, page_count, chunks_ordered, distinct_files,
    source_distribution, sources_by_file, dashboard_counts, job_summary, recent_activity, cache_stats, quality_label, header_detect, rotation_flag, session_upsert, session_recent, session_prune, crawl_bfs, stream_dedup_batch, stream_windows,
    stream_dedup_within, stream_sliding, stream_visits, chunk_records, insert_documents, status_indexed, clear_all, activity_append, message_append, reindex_all, listings, exists_probe, session_prune_count, role_check, totals, model_list,
]

SQL = {
    "sha_dedup": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "point_ids": "SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(coalesce(doc_id, 'None') || ':' || coalesce(page_num::VARCHAR, 'None'))) AS h FROM pages)",
    "chunk_records": "SELECT id, doc_id, coalesce(page, 0) AS page, coalesce(block_type, 'text') AS block_type, coalesce(chunk_index, 0) AS chunk_index, md5(coalesce(text, '')) AS text, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '') AS created_at FROM document_chunks",
    "insert_documents": "SELECT status, count(*) AS n, count(*) FILTER (WHERE filename = 'unknown') AS unknown, count(DISTINCT hash) AS hashes FROM (SELECT filename, hash, status FROM doc_versions UNION ALL SELECT coalesce(filename, 'unknown'), hash, 'processing' FROM documents) GROUP BY status",
    "status_indexed": f"SELECT id, CASE WHEN status IN ('indexed', 'failed') THEN status WHEN md5(id)[1] < '8' THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN (status IS NULL OR status NOT IN ('indexed', 'failed')) AND md5(id)[1] < '8' THEN '{AS_OF}' END AS indexed_at FROM doc_versions",
    "clear_all": "SELECT count(*) AS removed, 0::BIGINT AS left FROM document_chunks",
    "activity_append": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS outcome FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "message_append": "SELECT (SELECT max(id) FROM session_messages) + row_number() OVER (ORDER BY term_id) AS id, term AS content FROM glossary",
    "reindex_all": r"""WITH r AS (SELECT id, coalesce(trim(summary_text) NOT IN ('', '[Empty page]', '[Summarization failed]'), false) AS e, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(coalesce(doc_id, 'None') || ':' || coalesce(page_num::VARCHAR, 'None'))) AS h, len(regexp_extract_all(lower(summary_text), '[a-z0-9]+')) AS w FROM page_summaries)
        SELECT id, CASE WHEN e THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS point_id, e AS embedded, CASE WHEN e THEN CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS norm FROM r""",
    "listings": "SELECT id, row_number() OVER (ORDER BY ingested_at NULLS FIRST, id) AS oldest, row_number() OVER (ORDER BY ingested_at DESC NULLS LAST, id) AS newest FROM doc_versions WHERE status = 'indexed'",
    "exists_probe": "SELECT id FROM doc_versions v WHERE EXISTS (SELECT 1 FROM document_chunks c WHERE c.doc_id = v.id)",
    "session_prune_count": f"SELECT count(*) AS removed FROM sessions WHERE coalesce(last_active_at, created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY",
    "role_check": "SELECT session_id, array_to_string(list_sort(list(DISTINCT lower(role))), ',') AS unknown FROM session_messages WHERE session_id IS NOT NULL AND lower(role) NOT IN ('user', 'assistant', 'system', 'human', 'bot', 'ai') GROUP BY session_id",
    "totals": """WITH t AS (SELECT count(*) AS c, count(DISTINCT doc_id) AS n FROM document_chunks UNION ALL SELECT count(*) FILTER (WHERE embedded), count(DISTINCT doc_id) FROM page_summaries), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY ALL)
        SELECT sum(c)::BIGINT AS chunks, sum(n)::BIGINT AS documents, (SELECT count(*) FROM l WHERE last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS active FROM t""",
    "model_list": "SELECT name, row_number() OVER (ORDER BY name <> 'Brand#32', name) AS pos FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand <> 'Brand#11' AND NOT starts_with(p_brand, 'Brand#11:'))",
    "latest_by_name": "SELECT filename, id FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC NULLS LAST, id DESC) AS rn FROM doc_versions WHERE status = 'indexed' AND filename IS NOT NULL) WHERE rn = 1",
    "latest_by_source": "SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC NULLS LAST, id DESC) AS rn FROM doc_versions WHERE source_id IS NOT NULL) WHERE rn = 1",
    "upsert_last_wins": "SELECT doc_id, page_num, max(id) AS id FROM pages WHERE doc_id IS NOT NULL AND page_num IS NOT NULL GROUP BY ALL",
    "status_patch": "SELECT id, filename, coalesce(status, 'failed') AS status FROM doc_versions",
    "embedded_flags": "SELECT id, CASE WHEN md5(doc_id)[1] < '8' THEN false ELSE coalesce(embedded, false) END AS embedded FROM page_summaries",
    "cascade_delete": "SELECT doc_id, count(*) AS pages FROM pages WHERE doc_id NOT IN (SELECT id FROM doc_versions WHERE status = 'failed') OR doc_id IS NULL GROUP BY ALL",
    "delete_by_filename": "SELECT count(*) FILTER (WHERE filename IN ('scan.pdf', 'notes.pdf')) AS deleted, count(*) FILTER (WHERE filename IS NULL OR filename NOT IN ('scan.pdf', 'notes.pdf')) AS kept FROM documents",
    "swap_after": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC, id DESC) AS rn FROM doc_versions WHERE status = 'indexed' AND filename IS NOT NULL AND ingested_at IS NOT NULL) WHERE rn > 1",
    "ingest_verdict": """SELECT id, CASE WHEN hash IN (SELECT hash FROM doc_versions WHERE status = 'indexed' AND hash IS NOT NULL) THEN 'duplicate' WHEN filename IN (SELECT filename FROM doc_versions WHERE status = 'indexed' AND filename IS NOT NULL) THEN 'replaced' ELSE 'new' END AS verdict
        FROM doc_versions WHERE status <> 'indexed' OR status IS NULL""",
    "summary_page_join": "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY id) AS rn FROM pages) WHERE rn = 1) SELECT s.id, coalesce(len(p.headers), 0) AS n_headers, coalesce(p.has_tables, false) AS has_tables FROM page_summaries s LEFT JOIN p ON p.doc_id = s.doc_id AND p.page_num = s.page_num",
    "page_count": "SELECT v.id AS doc_id, coalesce(max(c.page), 0) AS page_count FROM doc_versions v LEFT JOIN document_chunks c ON c.doc_id = v.id GROUP BY v.id",
    "chunks_ordered": "SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, chunk_index NULLS FIRST, id) AS nth FROM document_chunks",
    "distinct_files": "SELECT DISTINCT filename FROM documents WHERE filename IS NOT NULL",
    "source_distribution": "SELECT coalesce(source, '') AS source, count(*) AS documents, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY ALL",
    "sources_by_file": "SELECT query_id, filename, string_agg(page_num::VARCHAR, ',' ORDER BY page_num) AS pages FROM (SELECT DISTINCT query_id, filename, page_num FROM search_results) GROUP BY ALL",
    "dashboard_counts": "SELECT count(*) FILTER (WHERE block_type = 'table') AS wiki_chunks, count(*) FILTER (WHERE coalesce(block_type, '') <> 'table') AS file_chunks, count(DISTINCT doc_id) AS documents, max(created_at) AS last_at, (SELECT count(*) FROM doc_versions WHERE status = 'indexed') AS indexed, (SELECT count(*) FROM page_summaries WHERE embedded) AS vectors FROM document_chunks",
    "job_summary": "WITH j AS (SELECT ts, CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS o FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT count(*) AS total, count(*) FILTER (WHERE o = 'success') AS success, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed, max(ts) AS last_job_at FROM j",
    "recent_activity": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS outcome FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "cache_stats": "WITH g AS (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS hit FROM events) SELECT count(DISTINCT user_id) AS size, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 3) AS hit_rate FROM g",
    "quality_label": "SELECT doc_id, CASE WHEN bool_and(round(score, 6) >= 0.5) THEN 'clean' WHEN NOT bool_or(round(score, 6) >= 0.5) THEN 'suspect' ELSE 'mixed' END AS label FROM search_results GROUP BY ALL",
    "header_detect": """WITH m AS (SELECT session_id AS page, coalesce(length(content), 0) AS size, coalesce(role, '') AS text, id AS pos FROM session_messages WHERE session_id IS NOT NULL),
        b AS (SELECT *, avg(size) OVER (PARTITION BY page) AS mean FROM m), f AS (SELECT page, text, min(pos) AS pos FROM b WHERE size > mean + 1.5 GROUP BY ALL)
        SELECT page, text, pos, nth FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS nth FROM f) WHERE nth <= 10""",
    "rotation_flag": "WITH c AS (SELECT doc_id AS page, CASE WHEN coalesce(length(text), 0) >= 3 THEN length(text) ELSE 0 END AS n, coalesce(block_type, '') = 'table' AS r FROM document_chunks) SELECT page, sum(n) >= 50 AND coalesce(sum(n) FILTER (WHERE r), 0) > 0.3 * sum(n) AS rotated FROM c GROUP BY ALL",
    "session_upsert": "WITH b AS (SELECT session_id, created_at AS c, coalesce(last_active_at, created_at) AS l FROM sessions UNION ALL SELECT session_id, created_at, created_at FROM session_messages WHERE session_id IS NOT NULL) SELECT session_id, min(c) AS created_at, max(l) AS last_active_at FROM b GROUP BY ALL",
    "session_recent": "WITH l AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM session_messages WHERE session_id IS NOT NULL) SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS pos FROM l WHERE rn <= 6",
    "session_prune": f"SELECT session_id, count(*) AS messages FROM session_messages WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM sessions WHERE coalesce(last_active_at, created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) GROUP BY ALL",
    "crawl_bfs": "WITH RECURSIVE w AS (SELECT 2::BIGINT AS node, 0 AS level UNION ALL SELECT d.doc_id, w.level + 1 FROM w JOIN documents d ON d.doc_id // 4 = w.node) SELECT node, level::BIGINT AS level FROM w",
    "stream_dedup_batch": "SELECT DISTINCT hash FROM documents WHERE hash IS NOT NULL UNION ALL SELECT NULL FROM documents WHERE hash IS NULL",
    "stream_dedup_within": "SELECT DISTINCT hash FROM documents WHERE hash IS NOT NULL UNION ALL SELECT NULL FROM documents WHERE hash IS NULL",
    "stream_sliding": """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), s AS (SELECT to_timestamp(0)::TIMESTAMP + to_hours(6) * ((epoch(ts)::BIGINT // 21600) - i) AS start, event_type, value FROM (SELECT ts, event_type, value, unnest(range(4)) AS i FROM events))
        SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s, m WHERE s.start + INTERVAL 24 HOUR <= wm GROUP BY s.start, event_type""",
    "stream_visits": """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events),
        v AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM v GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT wm FROM m)""",
    "stream_windows": "WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events) SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY ALL",
}
