"""Queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import answers, catalog, content, search, sources


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in [*search.QUERIES, *content.QUERIES, *catalog.QUERIES, *sources.QUERIES, *answers.QUERIES]}
    return found | {"vector_topk": search.vector_query, "hash_embed": search.hash_embed_query}


def oracle_sql() -> dict[str, str]:
    return search.SQL | content.SQL | catalog.SQL | sources.SQL | answers.SQL
