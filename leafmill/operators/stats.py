"""Counts and labels over catalogues, logs and page layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dashboard(chunks: DataFrame, by: str, wiki: str) -> DataFrame:
    """Chunks of the wiki and of files, distinct documents and the latest time, in one pass."""
    return chunks.agg(F.count_if(F.col(by) == wiki).alias("wiki_chunks"), F.count_if(F.coalesce(F.col(by), F.lit("")) != wiki).alias("file_chunks"), F.count_distinct("doc_id").alias("documents"), F.max("created_at").alias("last_at"))


def job_summary(events: DataFrame, newest: int = 50) -> DataFrame:
    """Outcomes of the newest jobs: failed is all that is neither a success nor skipped."""
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
    return last.agg(F.count("*").alias("total"), F.count_if(F.expr("outcome = 'success'")).alias("success"), F.count_if(F.expr("outcome = 'skipped'")).alias("skipped"), F.count_if(F.expr("outcome not in ('success', 'skipped')")).alias("failed"), F.max("ts").alias("last_job_at"))


def cache_stats(log: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a request log (key, ts, event_id): a request hits if its key was asked before within the hour."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    log = log.withColumn("hit", F.coalesce(gap <= 3_600_000_000, F.lit(False)))
    return log.agg(F.count_distinct("key").alias("size"), F.count_if(F.expr("hit")).alias("hits"), F.count_if(F.expr("not hit")).alias("misses"), F.round(F.count_if(F.expr("hit")) / F.count("*"), 3).alias("hit_rate"))


def quality(probes: DataFrame) -> DataFrame:
    """clean, mixed or suspect by how many of a document's probes hit."""
    g = probes.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.expr("hit")).alias("hits"))
    return g.select("doc_id", F.when(F.col("hits") == F.col("n"), "clean").when(F.col("hits") == 0, "suspect").otherwise("mixed").alias("label"))


def headers_by_size(spans: DataFrame) -> DataFrame:
    """Spans set over 1.5 points larger than their page's mean: the first ten distinct texts, in order."""
    big = spans.withColumn("_mean", F.avg("size").over(Window.partitionBy("page"))).where(F.col("size") > F.col("_mean") + 1.5)
    first = big.groupBy("page", "text").agg(F.min("pos").alias("pos"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where("nth <= 10")


def rotated(lines: DataFrame) -> DataFrame:
    """Pages of at least 50 characters in lines of three on, over 30 % of them in rotated lines."""
    n = F.when(F.col("n_chars") >= 3, F.col("n_chars")).otherwise(0)
    g = lines.groupBy("page").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("is_rotated"), n).otherwise(0)).alias("turned"))
    return g.select("page", ((F.col("total") >= 50) & (F.col("turned") > 0.3 * F.col("total"))).alias("rotated"))
