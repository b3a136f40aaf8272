"""From hits to a prompt: neighbouring pages, sources, the character budget, prompt text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN, TRUNCATE, LEAST_LEFT, UNKNOWN_PAGES = 4, 4000, 100, 9999


def neighbours(hits: DataFrame, pages: DataFrame, buffer: int = 1) -> DataFrame:
    """(query_id, doc_id, page_num, raw_text, is_direct, score) of each hit page and its neighbours that exist.

    hits: (query_id, doc_id, page_num, score, text); pages: (doc_id, page_num, raw_text), one row a page. Neighbours are kept between 1
    and the document's last page (an unknown document has no last page); a page that several hits name is direct if one of them hits it
    and has their best score. A hit page that is not stored keeps the hit's own text; other missing pages are dropped."""
    total = pages.groupBy("doc_id").agg(F.max("page_num").alias("_total"))
    h = hits.join(total, "doc_id", "left").withColumn("_total", F.coalesce("_total", F.lit(UNKNOWN_PAGES)))
    lo, hi = F.greatest(F.lit(1), F.col("page_num") - buffer), F.least("_total", F.col("page_num") + buffer)
    slots = h.withColumn("_slot", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    direct = F.col("_slot") == F.col("page_num")
    merged = slots.groupBy("query_id", "doc_id", F.col("_slot").alias("page_num")).agg(F.bool_or(direct).alias("is_direct"), F.max("score").alias("score"), F.max(F.when(direct, F.col("text"))).alias("_own"))
    out = merged.join(pages.select("doc_id", "page_num", "raw_text"), ["doc_id", "page_num"], "left").withColumn("raw_text", F.coalesce("raw_text", "_own"))
    return out.where("raw_text is not null").select("query_id", "doc_id", "page_num", "raw_text", "is_direct", "score")


def sources(hits: DataFrame) -> DataFrame:
    """The first hit of each document, in order of position, with the score to four places."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").withColumn("score", F.round("score", 4)).drop("_rn")


def fit_buffers(pages: DataFrame, budget: int) -> DataFrame:
    """Drops the neighbour pages of lowest score until the text fits the token budget; direct pages stay."""
    size, limit = F.length("raw_text"), CHARS_PER_TOKEN * (budget + 1)
    direct = F.sum(F.when(F.col("is_direct"), size).otherwise(0)).over(Window.partitionBy("query_id"))
    running = F.sum(size).over(Window.partitionBy("query_id", "is_direct").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("page_num")).rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("_d", direct).withColumn("_r", running).where(F.col("is_direct") | (F.col("_d") + F.col("_r") < limit)).drop("_d", "_r")


def truncate(pages: DataFrame, budget: int, descending: bool = False) -> DataFrame:
    """Cuts pages, walked by score (ascending by default), to what is left of the budget; a page with at most 100 characters left is dropped.

    A fold over the few pages of one question."""
    kinds = dict(pages.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id", "page_num"], ascending=[not descending, True, True], kind="stable").reset_index(drop=True)
        left, texts = budget * CHARS_PER_TOKEN, []
        for t in pdf["raw_text"]:
            if len(t) <= left:
                texts.append(t)
                left -= len(t)
            elif left > LEAST_LEFT:
                cut = t[: min(TRUNCATE, left)]
                texts.append(cut)
                left -= len(cut)
            else:
                texts.append(None)
        return pdf.assign(raw_text=texts).dropna(subset=["raw_text"])

    return pages.groupBy("query_id").applyInPandas(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def page_block(filename: Column, page: Column, headers: Column, text: Column) -> Column:
    """One page of a prompt: a title line with the heading trail, the text, an end line."""
    trail = F.when(F.size(headers) > 0, F.concat(F.lit("  ["), F.array_join(headers, " > "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("=== "), filename, F.lit(" — Page "), page, trail, F.lit(" ===\n"), text, F.lit("\n=== end ==="))


def prompt(pages: DataFrame, block: str, order: list[str], question: str = "question") -> DataFrame:
    """(query_id, prompt): the page blocks of a question in order, then the question."""
    return pages.groupBy("query_id").agg(F.first(question).alias("_q"), F.transform(F.sort_array(F.collect_list(F.struct(*order, block))), lambda x: x[block]).alias("_b")).select("query_id", F.concat(F.lit("=== documents ===\n"), F.array_join("_b", "\n"), F.lit("\n=== end of documents ===\nQuestion: "), "_q").alias("prompt"))
