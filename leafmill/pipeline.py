"""Whole flows: ingest pages, search, answer. Model calls are functions with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chunking, context, fusion, lexical
from leafmill.operators.vector import hash_embed, vector_topk


@dataclass
class Hooks:
    """embed: text column to vector column; summarise: page text to summary; rewrite: question to question; answer: prompt to answer."""

    embed: Callable[[Column], Column] = hash_embed
    summarise: Callable[[Column], Column] = field(default=lambda c: T.clean_summary(F.array_join(F.slice(F.split(c, r"(?<=[.?!])\s+"), 1, 3), " ")))
    rewrite: Callable[[Column], Column] = field(default=lambda q: q)
    answer: Callable[[Column], Column] = field(default=lambda p: p)


def ingest(pages: DataFrame, hooks: Hooks = Hooks(), most: int = 400, carry: int = 50) -> DataFrame:
    """(doc_id, page_num, chunk_no, chunk, embedding) of page rows (doc_id, page_num, raw_text): chunked and embedded."""
    keyed = pages.where("length(raw_text) > 0").withColumn("_k", F.struct("doc_id", "page_num"))
    return chunking.sentence_chunks(keyed, "_k", "raw_text", most, carry).select("_k.*", "chunk_no", "chunk", hooks.embed(F.col("chunk")).alias("embedding"))


def search(chunks: DataFrame, questions: DataFrame, hooks: Hooks = Hooks(), k: int = 8, hard: float = 0.25, soft: float = 0.15) -> DataFrame:
    """Hybrid search of questions (query_id, query) over ingest()'s chunks: (query_id, doc, page_num, text, rrf_rank, score, pos)."""
    rows = chunks.withColumn("key", F.xxhash64("doc_id", "page_num", "chunk_no"))
    q = questions.select("query_id", hooks.rewrite(F.col("query")).alias("query")).withColumn("vector", hooks.embed(F.col("query")))
    v = vector_topk(rows, q, 5 * k, "key").withColumn("list_no", F.lit(1)).withColumn("is_vec", F.lit(True))
    b = lexical.bm25(lexical.postings(rows, "key", "chunk"), q, 5 * k).withColumn("list_no", F.lit(2)).withColumn("is_vec", F.lit(False))
    hits = v.unionByName(b).join(rows.select("key", F.col("doc_id").alias("doc"), "page_num", F.col("chunk").alias("text")), "key")
    return fusion.quota(fusion.rrf(hits, ["doc", "page_num"], ["text"]), k, hard, soft)


def answer(hits: DataFrame, pages: DataFrame, questions: DataFrame, hooks: Hooks = Hooks(), budget: int = 100_000, buffer: int = 1) -> DataFrame:
    """(query_id, prompt, answer) from search()'s hits: neighbours, budget, prompt."""
    h = hits.select("query_id", F.col("doc").alias("doc_id"), "page_num", "score", "text")
    found = context.truncate(context.fit_buffers(context.neighbours(h, pages, buffer), budget), budget).join(questions, "query_id")
    block = context.page_block(F.col("doc_id"), F.col("page_num"), F.array().cast("array<string>"), F.col("raw_text"))
    out = context.prompt(found.withColumn("block", block), "block", ["doc_id", "page_num"], "query")
    return out.withColumn("answer", hooks.answer(F.col("prompt")))
