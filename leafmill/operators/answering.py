"""The first generation's way from a question to its passages: file routing, fusion by text, recency, sub-questions, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import fusion
from leafmill.operators.lexical import bm25
from leafmill.operators.vector import cosine, vector_topk
from leafmill.session import sized


def hybrid(posts: DataFrame, items: DataFrame, questions: DataFrame, texts: DataFrame, k: int, threshold: float, as_of: Column) -> DataFrame:
    """(query_id, key, filename, text, score, pos): up to 3k passages of each question (query_id, query, vector, file).

    items: (key, embedding); texts: (key, filename, text, at). Both searches take 3k; vector hits under the threshold, to four places, are
    left out behind that cut. A question that names a file gets vectors of that file only, and of its keyword hits those of the file.
    Lists are fused by the text's first characters; newer passages gain up to 0.01."""
    n = 3 * k
    files = texts.select("key", "filename")
    free, bound = questions.where("file is null"), questions.where("file is not null")
    some = vector_topk(items, free, n, "key").select("query_id", "key", "score", "rank")
    own = bound.where("vector is not null").join(items.join(files, "key"), F.col("file") == F.col("filename"))
    own = own.select("query_id", "key", F.round(cosine(F.col("vector"), F.col("embedding")), 6).alias("score"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= n)
    vectors = some.unionByName(own).where(F.round("score", 4) >= threshold).withColumn("is_vec", F.lit(True))
    words = bm25(posts, questions, n).join(files, "key").join(questions.select("query_id", "file"), "query_id").where("file is null or file = filename")
    words = words.select("query_id", "key", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"), F.lit(False).alias("is_vec"))
    hits = vectors.unionByName(words).persist()
    keys = hits.select("key").distinct().persist()
    hits = hits.join(texts.join(sized(keys), "key", "left_semi"), "key")  # no text is shuffled but those found
    fused = fusion.rrf_by_text(hits, extra=["key", "filename", "at"])
    fused = fused.withColumn("score", fusion.recency(F.col("score"), F.col("at"), as_of))
    fused = fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place")))
    return fused.where(F.col("pos") <= n).select("query_id", "key", "filename", "text", "score", "pos")


def collapsed(posts: DataFrame, items: DataFrame, questions: DataFrame, texts: DataFrame, threshold: float, as_of: Column, retrieve: int = 20, final: int = 10) -> DataFrame:
    """(query_id, key, score, pick): sub-questions that all point to one file are searched as one question, deeper; passages with tables
    gain where the question compares. texts also has has_table."""
    found = hybrid(posts, items, questions, texts, retrieve, threshold, as_of).join(texts.select("key", "has_table"), "key").join(questions.select("query_id", "query"), "query_id")
    found = found.withColumn("score", fusion.table_boost(F.col("score"), F.col("query"), F.col("has_table")))
    found = found.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))
    return fusion.mmr(found.select("query_id", "key", F.col("text").alias("document"), "score", "pos"), final).select("query_id", "key", "score", "pick")


def assemble(hits: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, key, filename, pick): passages of all sub-questions of a question as its context.

    hits: (query_id, key, filename, text, score, at), `at` their order. Repeats by their first characters go, sources take turns, MMR
    picks `most`, and each source without a pick adds its first passage behind them, in order of the sources' first appearance."""
    once = fusion.first_by_prefix(hits, "text", "at")
    turns = fusion.interleave(once, "filename", "at")
    picked = fusion.mmr(turns.select("query_id", "key", "filename", F.col("text").alias("document"), "score", "pos", "at"), most)
    first = turns.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "filename").orderBy("at"))).where("_rn = 1")
    absent = first.join(picked.select("query_id", "filename").distinct(), ["query_id", "filename"], "left_anti").select("query_id", "key", "filename", "at", F.lit(None).cast("bigint").alias("pick"))
    both = picked.select("query_id", "key", "filename", "at", "pick").unionByName(absent)
    return both.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pick"), "at"))).select("query_id", "key", "filename", "pick")
