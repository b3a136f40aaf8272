"""Queries over parsed web pages and wiki answers, and the whole flow from pages to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import pipeline
from leafmill.operators.catalog import latest
from leafmill.sources import html, wiki


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _web(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").where("length(raw_text) > 0")
    safe = F.replace(F.replace(F.replace("raw_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.when(F.size("headers") > 0, F.concat(F.lit("<h2>"), F.col("headers")[0], F.lit("</h2>"))).otherwise("")
    return p.select("id", F.concat(F.lit("<html><body>"), head, F.lit("<p>"), F.array_join(F.split(safe, "\n\n"), "</p><p>"), F.lit("</p><table><tr><th>a</th><th colspan=2>b</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table></body></html>")).alias("html"))


def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages as web pages, parsed to typed chunks."""
    return html.parse(_web(spark, d), "id", "html")


def wiki_normalise(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "documents").where("filename is not null").select("doc_id", F.to_json(F.struct(F.concat(F.col("filename"), F.lit(" &amp; more")).alias("title"), F.struct(F.struct(F.lit("<p/>").alias("value")).alias("storage")).alias("body"), F.struct(F.lit("2024-01-01").alias("createdAt"), F.lit("u1").alias("authorId")).alias("version"))).alias("json"))
    return wiki.normalised(x).select("doc_id", "title", "content", "url", "updated", "author")


def answer_flow(spark: SparkSession, d: str) -> DataFrame:
    """Pages chunked, embedded, searched for each glossary term and made into prompts."""
    p = latest(_t(spark, d, "pages").where("length(raw_text) > 0 and doc_id is not null and page_num is not null"), ["doc_id", "page_num"], [F.asc("id")]).select("doc_id", "page_num", "raw_text")
    q = _t(spark, d, "glossary").where("term_id % 50 = 0").select(F.col("term_id").cast("bigint").alias("query_id"), F.col("term").alias("query"))
    # the chunks feed both indexes; kept, as a lost part is computed again
    out = pipeline.answer(pipeline.search(pipeline.ingest(p).persist(), q).persist(), p, q, budget=4000)
    return out.select("query_id", F.length("prompt").cast("bigint").alias("n_chars"))


QUERIES = [html_chunks, wiki_normalise, answer_flow]
SQL = {"wiki_normalise": "SELECT doc_id, filename || ' & more' AS title, '<p/>' AS content, '' AS url, '2024-01-01' AS updated, 'u1' AS author FROM documents WHERE filename IS NOT NULL"}
