"""Fusing ranked lists, diversity and boosts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
LAMBDA = 0.6


def rrf(hits: DataFrame, keys: list[str], extra: list[str] = []) -> DataFrame:
    """Reciprocal rank fusion of hits (query_id, list_no, rank, is_vec, score, *keys): one row per key with rrf, rrf_rank, score, is_vec.

    Every occurrence adds 1 / (60 + rank). A key is represented by its best vector hit, else by its first other hit with a cosine of 0;
    ties of the sum keep the order of first appearance (list, rank)."""
    first = F.struct(F.col("list_no"), F.col("rank"))
    best = F.struct(F.col("is_vec"), F.when(F.col("is_vec"), F.col("score")).otherwise(0.0).alias("s"), (-F.col("list_no")).alias("l"), (-F.col("rank")).alias("r"))
    take = F.struct(F.when(F.col("is_vec"), F.col("score")).otherwise(F.lit(0.0)).alias("score"), "is_vec", *extra)
    fused = hits.groupBy("query_id", *keys).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.min(first).alias("_first"), F.max_by(take, best).alias("_rep"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "_first")
    return fused.withColumn("rrf_rank", F.row_number().over(w)).select("query_id", *keys, "rrf", "rrf_rank", "_rep.*")


def rrf_by_text(hits: DataFrame, text: str = "text", prefix: int = 120, extra: list[str] = []) -> DataFrame:
    """Fusion keyed by the first characters of the text: (query_id, prefix, text, *extra, score, place).

    hits: (query_id, is_vec, rank, text). Represented by the last vector hit, else by the first keyword hit. score is the sum of
    1 / (60 + rank), to six places; place the order by the sum, ties by first appearance, vector hits first."""
    h = hits.withColumn("prefix", F.substring(text, 1, prefix))
    rep = F.struct(F.col("is_vec"), F.when(F.col("is_vec"), F.col("rank")).otherwise(-F.col("rank")).alias("o"))
    out = h.groupBy("query_id", "prefix").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("_sum"), F.min(F.struct(~F.col("is_vec"), "rank")).alias("_first"), F.max_by(F.struct(text, *extra), rep).alias("_rep"))
    # the sum's last digits depend on the order of adding, so that equal sums are told by twelve places
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("_sum", 12)), "_first"))
    return out.select("query_id", "prefix", "_rep.*", F.round("_sum", 6).alias("score"), place.alias("place"))


def quota(hits: DataFrame, k: int, hard: float = 0.25, soft: float = 0.15, doc: str = "doc") -> DataFrame:
    """Two-tier quota over hits (query_id, doc, rrf_rank, score): at most k per question, `pos` is the final place.

    Documents with a hit of at least `soft` share k: each is guaranteed max(1, k // n) of its hits in fusion order; what is left of k
    goes to further hits of at least `hard`, up to max(2, k // n) a document. The result is ordered by score."""
    by = Window.partitionBy("query_id")
    n = F.greatest(F.size(F.collect_set(F.when(F.col("score") >= soft, F.col(doc))).over(by)), F.lit(1))
    h = hits.withColumn("_n", n).withColumn("_share", F.floor(F.lit(k) / F.col("_n")))
    h = h.withColumn("_ok", F.max(F.when(F.col("score") >= soft, 1).otherwise(0)).over(Window.partitionBy("query_id", doc)) == 1)
    in_doc = F.row_number().over(Window.partitionBy("query_id", doc).orderBy("rrf_rank"))
    h = h.withColumn("_may", F.col("_ok") & (in_doc <= F.greatest(F.lit(1), F.col("_share"))))
    order = Window.partitionBy("query_id", "_may").orderBy("rrf_rank")
    h = h.withColumn("_g", F.col("_may") & (F.row_number().over(order) <= k))
    taken_doc = F.sum(F.when(F.col("_g"), 1).otherwise(0)).over(Window.partitionBy("query_id", doc))
    taken = F.sum(F.when(F.col("_g"), 1).otherwise(0)).over(by)
    h = h.withColumn("_td", taken_doc).withColumn("_t", taken).withColumn("_e", ~F.col("_g") & (F.col("score") >= hard))
    h = h.withColumn("_ed", F.row_number().over(Window.partitionBy("query_id", doc, "_e").orderBy("rrf_rank")))
    h = h.withColumn("_e", F.col("_e") & (F.col("_ed") <= F.greatest(F.lit(2), F.col("_share")) - F.col("_td")))
    h = h.withColumn("_eg", F.row_number().over(Window.partitionBy("query_id", "_e").orderBy("rrf_rank")))
    h = h.withColumn("_pass", F.when(F.col("_g"), 1).when(F.col("_e") & (F.col("_eg") <= F.lit(k) - F.col("_t")), 2)).where("_pass is not null")
    pos = F.row_number().over(by.orderBy(F.desc("score"), "_pass", "rrf_rank"))
    return h.withColumn("pos", pos).select(*hits.columns, "pos")


def mmr(candidates: DataFrame, k: int) -> DataFrame:
    """Maximal marginal relevance over candidates (query_id, pos, document, score), at most a few dozen a question; adds `pick`.

    Up to k candidates pass as they are. The first pick has the highest relative score; each further one maximises
    0.6 * relevance - 0.4 * the largest word overlap with a picked one; the earlier candidate wins ties."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        if len(pdf) <= k:
            return pdf.assign(pick=range(1, len(pdf) + 1))
        rel = pdf["score"] / (pdf["score"].max() or 1.0)
        sets = [set((d or "").lower().split()) for d in pdf["document"]]
        left, picked, nearest = list(range(len(pdf))), [], [0.0] * len(pdf)
        while left and len(picked) < k:
            best = max(left, key=lambda i: (rel[i] if not picked else LAMBDA * rel[i] - (1 - LAMBDA) * nearest[i], -i))
            left.remove(best)
            picked.append(best)
            for i in left:
                both = len(sets[i] | sets[best])
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / both if both else 0.0)
        return pdf.iloc[picked].assign(pick=range(1, len(picked) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", pick bigint"
    return candidates.groupBy("query_id").applyInPandas(run, schema)


def recency(score: Column, at: Column, as_of: Column) -> Column:
    """A bonus of up to 0.01 that decays over a year; without a date the score stays."""
    days = F.greatest(F.datediff(as_of, at), F.lit(0))
    return F.coalesce(F.round(score + 0.01 * F.exp(-days / 365.0), 6), score)


def table_boost(score: Column, question: Column, has_table: Column) -> Column:
    from leafmill.functions.text import TABLE_BOOST, signals

    asks = (F.size(signals(question, TABLE_BOOST)) > 0) | (F.regexp_count(question, F.lit(r"\b(?:19|20)\d{2}\b")) >= 2)
    return F.when(asks & has_table, F.round(score + 0.02, 6)).otherwise(score)


def interleave(hits: DataFrame, source: str, order: str) -> DataFrame:
    """Round robin over sources in the order of their first appearance; adds `pos`."""
    in_source = F.row_number().over(Window.partitionBy("query_id", source).orderBy(order))
    first = F.min(order).over(Window.partitionBy("query_id", source))
    return hits.withColumn("_r", in_source).withColumn("_f", first).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "_f"))).drop("_r", "_f")


def first_by_prefix(hits: DataFrame, text: str, order: str, prefix: int = 120) -> DataFrame:
    """The first hit of those that begin with the same characters."""
    w = Window.partitionBy("query_id", F.substring(text, 1, prefix)).orderBy(order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_subqueries(hits: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Best score per key over sub-questions (query_id, sub_idx, pos, score, *keys), the earlier one on ties, of at least the threshold."""
    best = F.max_by(F.struct("score", "sub_idx"), F.struct("score", (-F.col("sub_idx")).alias("s"), (-F.col("pos")).alias("p")))
    return hits.groupBy("query_id", *keys).agg(best.alias("_b")).select("query_id", *keys, "_b.*").where(F.col("score") >= threshold)
