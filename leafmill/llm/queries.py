"""The queries of this folder over the project's tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import conversations, history, packing, residue, scan_noise, shared_spans, split, tokens
from leafmill.llm.common import table


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The four fixed limits."""
    return {r["limit_name"]: r["amount"] for r in table(spark, sf_dir, "size_limits").select("limit_name", "amount").limit(100).collect()}


def _noise_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("pages", "search_results", "page_summaries", "glossary")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noise(*_noise_tables(spark, sf_dir))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.clean_pages(*_noise_tables(spark, sf_dir))


def p1_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.clean_headings(*_noise_tables(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = limits(spark, sf_dir)
    return split.oversized_pages(table(spark, sf_dir, "pages"), n["page_chars"], n["piece_overlap"])


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = limits(spark, sf_dir)
    return split.split_pages(table(spark, sf_dir, "pages"), n["page_chars"], n["piece_overlap"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf_dir, "sessions"), conversations.Replay(table(spark, sf_dir, "session_messages")))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(conversations.Replay(table(spark, sf_dir, "session_messages")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeats(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_rows(table(spark, sf_dir, "page_summaries")).select(F.col("id").alias("summary_id"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries that remain."""
    rows = table(spark, sf_dir, "page_summaries")
    return rows.join(residue.residue_rows(rows), "id", "left_anti").where(r"summary_text rlike '\\S'").select("id", "doc_id", "page_num", "summary_text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["container_size"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_documents(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["shared_span"])


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["shared_span"])


def p8_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_amounts(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["shared_span"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pages, p1_headings, p2_found, p2_pieces, p3_found, p3_conversations, p4_found, p5_found, p5_kept, p6_ids, p7_containers, p8_found, p8_spans, p8_amounts)}
