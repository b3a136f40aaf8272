"""Sessions of messages: upsert, recent history, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with the earliest creation and the latest activity known."""
    seen = messages.where("session_id is not null").select("session_id", F.col("created_at").alias("c"), F.col("created_at").alias("l"))
    both = sessions.select("session_id", F.col("created_at").alias("c"), F.coalesce("last_active_at", "created_at").alias("l")).unionByName(seen)
    return both.groupBy("session_id").agg(F.min("c").alias("created_at"), F.max("l").alias("last_active_at"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session, with `pos` from the oldest of these."""
    w = Window.partitionBy("session_id")
    last = messages.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("id")))).where(F.col("_rn") <= n)
    return last.withColumn("pos", F.row_number().over(w.orderBy("id"))).drop("_rn")


def stale(sessions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sessions whose last activity lies more than `days` days before."""
    return sessions.where(F.coalesce("last_active_at", "created_at") < as_of - F.make_dt_interval(F.lit(days)))


def pruned(sessions: DataFrame, messages: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """What remains of sessions and messages without the stale sessions."""
    gone = stale(sessions, as_of, days).select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")
