"""The catalogue of files: duplicates, versions, replacement, cascades. Tables are snapshots; each function gives the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


#: The namespace of names that are domains (fixed value).
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(*parts: Column) -> Column:
    """A deterministic id of a key; a null part is named None, so that it equals no other."""
    joined = parts[0]
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    for i, t in enumerate(texts):
        joined = t if i == 0 else F.concat(joined, F.lit(":"), t)
    return uuid5(joined)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; order must be total. Only the best row of a key leaves its task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """table with rows written over it: the last write of a key wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.desc("_new"), *order]).drop("_new")


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: a change's non-null columns replace the row's; rows without a change stay."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    out = table.join(c, key, "left")
    return out.select(*[F.coalesce(f"_{x}", x).alias(x) if x != key and f"_{x}" in out.columns else F.col(x) for x in table.columns])


def cascade(children: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The children whose parent is not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def replaced(versions: DataFrame, done: str = "indexed") -> DataFrame:
    """Old versions to evict once a newer one is complete: all but the latest complete row of each name."""
    complete = versions.where(F.col("status") == done)
    keep = latest(complete.where("filename is not null"), ["filename"], [F.desc("ingested_at"), F.desc("id")])
    return complete.where("filename is not null").join(keep.select("id"), "id", "left_anti")


def verdict(new: DataFrame, versions: DataFrame, done: str = "indexed") -> DataFrame:
    """new (id, filename, hash) with `verdict`: duplicate (same content complete), replaced (same name, other content) or new."""
    complete = versions.where(F.col("status") == done)
    same = complete.where("hash is not null").select("hash").distinct().withColumn("_dup", F.lit(True))
    named = complete.where("filename is not null").select("filename").distinct().withColumn("_named", F.lit(True))
    out = new.join(same, "hash", "left").join(named, "filename", "left")
    return out.withColumn("verdict", F.when(F.col("_dup"), "duplicate").when(F.col("_named"), "replaced").otherwise("new")).drop("_dup", "_named")


def inserted(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """table with rows appended; columns that a row lacks or leaves null take the defaults, others stay null."""
    known = [F.coalesce(rows[c], defaults[c]).alias(c) if c in rows.columns and c in defaults else rows[c] if c in rows.columns else defaults.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in table.dtypes]
    return table.unionByName(rows.select(*known))


def with_status(table: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """table (id, status, indexed_at, …) with the status of changes (id, status); indexed_at is set by the status indexed only."""
    c = changes.select("id", F.col("status").alias("_status"))
    out = table.join(c, "id", "left")
    return out.select(*[F.coalesce("_status", "status").alias(x) if x == "status" else F.when(F.col("_status") == "indexed", at).otherwise(F.col("indexed_at")).alias(x) if x == "indexed_at" else F.col(x) for x in table.columns])


def cleared(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the empty table, (removed) how many rows went)."""
    return table.limit(0), table.agg(F.count("*").alias("removed"))


def appended(log: DataFrame, rows: DataFrame, keep: int, order: list[Column]) -> DataFrame:
    """A log with rows added, of which the first `keep` in the given order stay."""
    return log.unionByName(rows).orderBy(*order).limit(keep)


def numbered_after(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ids that go on after the table's greatest, in the given order."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_n")).drop("_n", "_last")


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks as they go to the vector store: scalar fields only, none null."""
    fill = {"page": F.lit(0), "block_type": F.lit("text"), "chunk_index": F.lit(0), "text": F.lit("")}
    return chunks.select("id", "doc_id", *(F.coalesce(c, v).alias(c) for c, v in fill.items()), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created_at"))


def reindexed(summaries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, doc_id, page_num, point_id, vector, embedded) of all summaries that hold anything, embedded anew; the others lose their flag."""
    real = F.coalesce(~F.trim("summary_text").isin("", "[Empty page]", "[Summarization failed]"), F.lit(False))
    return summaries.select("id", "doc_id", "page_num", F.when(real, point_id(F.col("doc_id"), F.col("page_num"))).alias("point_id"), F.when(real, embed(F.col("summary_text"))).alias("vector"), real.alias("embedded"))
