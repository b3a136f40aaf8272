"""Rebuilding conversations from message rows with keyed streaming state.

Rows are a stream in their order of arrival. A first stateful step buffers them by session and hour of event time until the watermark
has passed the hour, so that late arrivals find their place; then the hour is put in order, rid of repeats and emitted with a summary of
what its sequence of roles says about validity. A second one holds a session's summaries until nothing more has come for a while (its
timeout) and emits the verdict on it. Summaries combine in order, so no task ever holds a whole session, and a session that goes on after
its timeout is still one conversation. All of it is native: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.llm.common import new_path

BLOCK, REPEAT_S = "1 hour", 5
#: How far behind the latest event a row may come; how long after its last message a session is over.
LATENESS, TIMEOUT = "30 days", "7 days"
#: Characters that show nothing besides separators, controls and format characters: fillers, joiners and variation selectors (fixed values).
INVISIBLE = r"\p{Z}\p{C}\s\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"
COLUMNS = ["id", "session_id", "role", "content", "created_at"]
SUMMARY = "broken boolean, blank boolean, users bigint, leads boolean, lead_answered boolean, unanswered boolean, tail_answered boolean"
#: The session of the rows that only tell the time.
CLOCK = "\0clock"


def plain_role(role: Column) -> Column:
    """user, assistant or system; null for any other or missing role."""
    r = F.lower(F.regexp_replace(role, r"^\s+|\s+$", ""))
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "bot", "ai"), "assistant").when(r == "system", "system")


def answer_text(content: Column) -> Column:
    """content without its think blocks (an unclosed one goes to the end)."""
    return F.regexp_replace(content, r"(?s)<think>.*?(?:</think>|\z)", "")


def is_blank(content: Column) -> Column:
    return ~F.coalesce(answer_text(content).rlike(f"[^{INVISIBLE}]"), F.lit(False))


def _rows(messages: DataFrame) -> DataFrame:
    """Message rows of sessions with plain roles; system rows only if they lack a time, which breaks their session."""
    at = F.col("created_at").cast("timestamp")
    rows = messages.select(F.col("session_id").cast("string"), F.col("id").cast("bigint"), plain_role(F.col("role")).alias("role"), "content", F.unix_micros(at).alias("us"))
    return rows.where("session_id is not null and (role is null or role <> 'system' or us is null)").withColumn("blank", is_blank(F.col("content")))


def ordered_blocks(messages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first step, as a stream: (session_id, block, rows, broken, timed).

    rows: (us, id, role, content, blank) in order, without those that repeat an earlier one at most REPEAT_S seconds before; emitted
    when the watermark has passed the block (its first microsecond). Rows without a time have no place in event time and wait for
    nothing: each is emitted at once as a broken block without a number. Rows stamped before 1970 or more than a day after now are
    blocks of their own (timed is false) and leave the watermark alone; repeats among these stay."""
    rows, far = _rows(messages), F.unix_micros(F.current_timestamp()) + 86_400_000_000
    in_time = F.coalesce(((F.col("us") <= far) & (F.col("us") >= 0)) | (F.col("session_id") == CLOCK), F.lit(False))
    timed = rows.where(in_time)
    # a row near a block's end is also sent to the next one, as context, with that one's first moment for its time
    hour = lambda us: F.expr(f"{us} - pmod({us}, 3600000000L)")
    spill = hour(f"(us + {REPEAT_S * 1_000_000}L)")
    places = F.array_compact(F.array(F.struct(F.col("us").alias("at"), F.lit(True).alias("own")), F.when(spill > F.col("us"), F.struct(spill.alias("at"), F.lit(False).alias("own")))))
    timed = timed.withColumn("_p", F.explode(places)).withColumn("event_at", F.timestamp_micros("_p.at")).withColumn("own", F.col("_p.own")).withWatermark("event_at", lateness)
    held = timed.groupBy("session_id", F.window("event_at", BLOCK).alias("w")).agg(F.sort_array(F.collect_list(F.struct("role", "content", "us", "id", "blank", "own"))).alias("_s"))
    again = lambda x, p: p["role"].eqNullSafe(x["role"]) & p["content"].eqNullSafe(x["content"]) & (x["us"] - p["us"] <= REPEAT_S * 1_000_000)
    held = held.withColumn("_f", F.filter("_s", lambda x, i: x["own"] & ~((i > 0) & F.coalesce(again(x, F.get("_s", i - 1)), F.lit(False)))))
    order = F.sort_array(F.transform("_f", lambda x: F.struct(*(x[c].alias(c) for c in ("us", "id", "role", "content", "blank")))))
    blocks = held.select("session_id", F.unix_micros("w.start").alias("block"), order.alias("rows")).where("size(rows) > 0")
    blocks = blocks.withColumn("broken", F.exists("rows", lambda x: x["role"].isNull())).withColumn("timed", F.lit(True))
    apart = rows.where(~in_time).select("session_id", F.col("us").alias("block"), F.array(F.struct("us", "id", "role", "content", "blank")).alias("rows"), (F.col("role").isNull() | F.col("us").isNull()).alias("broken"), F.lit(False).alias("timed"))
    return blocks.unionByName(apart)


def summary(rows: Column, broken: Column) -> Column:
    """What a block contributes to its session's validity: a fold over the rows in order."""
    start = F.struct(*(F.lit(0 if kind == "bigint" else False).cast(kind).alias(name) for name, kind in (x.split() for x in SUMMARY.split(", "))))

    def step(s: Column, x: Column) -> Column:
        user, real = F.coalesce(x["role"] == "user", F.lit(False)), F.coalesce((x["role"] == "assistant") & ~x["blank"], F.lit(False))
        first = s["users"] == 0
        return F.struct(
            s["broken"].alias("broken"),
            (s["blank"] | (user & x["blank"])).alias("blank"),
            (s["users"] + F.when(user, 1).otherwise(0)).cast("bigint").alias("users"),
            (s["leads"] | (first & ~user)).alias("leads"),  # rows before the first user message
            (s["lead_answered"] | (first & real)).alias("lead_answered"),
            (s["unanswered"] | (user & ~first & ~s["tail_answered"])).alias("unanswered"),
            (~user & (s["tail_answered"] | (~first & real))).alias("tail_answered"),
        )

    return F.aggregate(rows, start, step).withField("broken", broken)


def combined(parts: str) -> str:
    """SQL: the summaries of consecutive stretches, an array of structs (block, s) in order, as one."""
    return f"""aggregate({parts}, cast(null as struct<{SUMMARY.replace(" ", ":").replace(",:", ",")}>), (a, p) -> if(a is null, p.s, named_struct(
        'broken', a.broken or p.s.broken, 'blank', a.blank or p.s.blank, 'users', a.users + p.s.users,
        'leads', a.leads or (a.users = 0 and p.s.leads), 'lead_answered', a.lead_answered or (a.users = 0 and p.s.lead_answered),
        'unanswered', a.unanswered or p.s.unanswered or (a.users > 0 and p.s.users > 0 and not (a.tail_answered or p.s.lead_answered)),
        'tail_answered', if(p.s.users > 0, p.s.tail_answered, a.tail_answered or (a.users > 0 and p.s.lead_answered)))))"""


VALID = "not s.broken and not s.blank and not s.unanswered and not s.leads and s.users > 0 and s.tail_answered"


def closed_sessions(blocks: DataFrame, timeout: str = TIMEOUT) -> DataFrame:
    """The second step, as a stream over ordered_blocks(): (session_id, block, s, valid) of each session that is over.

    s sums up all since its first block, or since the timeout before. Blocks come in order of the first step's watermark, so none is
    late here. A session holds one summary an hour at most."""
    parts = blocks.where("timed").select("session_id", "block", summary(F.col("rows"), F.col("broken")).alias("s"))
    parts = parts.withColumn("closed_at", F.timestamp_micros("block")).withWatermark("closed_at", BLOCK)
    held = parts.groupBy("session_id", F.session_window("closed_at", timeout).alias("w")).agg(F.sort_array(F.collect_list(F.struct("block", "s"))).alias("p"))
    return held.select("session_id", F.col("p")[0]["block"].alias("block"), F.expr(combined("p")).alias("s")).withColumn("valid", F.expr(VALID))


class Replay:
    """A table of messages sent through the stream in its order of arrival (id), in several triggers.

    blocks, closed: what the two steps emitted. late: the rows that came later than `lateness` and were left out, as Spark counts them."""

    def __init__(self, messages: DataFrame, lateness: str = LATENESS, timeout: str = TIMEOUT, triggers: int = 4):
        spark = messages.sparkSession
        self.late, self._spark = 0, spark
        arrived, out, over, *states = (new_path(spark, f"messages-{x}") for x in ("arrived", "blocks", "closed", "state1", "state2"))
        messages = messages.select(COLUMNS)
        lo, hi, last, splits = messages.withColumn("_split", F.spark_partition_id()).agg(F.min("id"), F.max("id"), F.max(F.unix_micros(F.col("created_at").cast("timestamp"))), F.max("_split")).first()
        files, step = max(1, ((splits or 0) + 1) // triggers), -(-((hi or 0) - (lo or 0) + 1) // triggers)
        for i in range(triggers):  # files are read in order of their time
            part = messages.where(F.coalesce(F.floor((F.col("id") - F.lit(lo)) / step), F.lit(0)) == i)
            part.repartition(files).write.mode("append").parquet(arrived)
        blocks = ordered_blocks(spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", files).parquet(arrived), lateness)
        self._run(blocks, out, states[0])
        closed = closed_sessions(spark.readStream.schema(blocks.schema).parquet(out), timeout)
        self._run(closed, over, states[1])
        if last is not None:
            # the input has ended: the clock goes on past lateness and timeout, as it does by itself in a stream that goes on
            now = F.timestamp_micros(F.lit(max(last, 0)).cast("bigint"))
            for wait in (lateness, timeout, "3 hours"), (lateness, "3 hours"):
                for w in wait:
                    now = now + F.expr(f"interval {w}")
                tick = {"id": F.lit(None), "session_id": F.lit(CLOCK), "role": F.lit("user"), "content": F.lit(""), "created_at": now}
                spark.range(1).select(*(tick[f.name].cast(f.dataType).alias(f.name) for f in messages.schema)).coalesce(1).write.mode("append").parquet(arrived)
                self._run(blocks, out, states[0])
            self._run(closed, over, states[1])
        self.blocks = spark.read.schema(blocks.schema).parquet(out).where(F.col("session_id") != CLOCK)
        self.closed = spark.read.schema(closed.schema).parquet(over).where(F.col("session_id") != CLOCK)

    def _run(self, rows: DataFrame, out: str, state: str) -> None:
        """All that has arrived by now, file group after file group."""
        query: StreamingQuery = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        self.late += sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def valid_sessions(stream: Replay) -> DataFrame:
    """(session_id, valid): the verdict on each session from what the stream emitted of it, in order of time."""
    apart = stream.blocks.where("not timed and block is not null").select("session_id", "block", F.col("rows")[0]["id"].alias("id"), summary(F.col("rows"), F.col("broken")).alias("s"))
    parts = stream.closed.select("session_id", "block", F.lit(None).cast("bigint").alias("id"), "s").unionByName(apart)
    whole = parts.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("block", "id", "s"))).alias("p")).select("session_id", F.expr(combined("p")).alias("s"))
    broken = stream.blocks.where("block is null").select("session_id").distinct()
    return whole.join(broken.withColumn("_b", F.lit(True)), "session_id", "left").select("session_id", (F.expr(VALID) & F.col("_b").isNull()).alias("valid"))


def dropped_sessions(sessions: DataFrame, stream: Replay) -> DataFrame:
    """(session_id) of the sessions without a valid conversation; sessions without any row count as such, null ids are left out."""
    valid = valid_sessions(stream).where("valid").select("session_id")
    return sessions.where("session_id is not null").select(F.col("session_id").cast("string")).distinct().join(valid, "session_id", "left_anti")


def conversations(stream: Replay) -> DataFrame:
    """(session_id, position, id, role, content, created_at) of the valid sessions, in order; content without think blocks.

    A row's position is its place in the block plus the rows of the session's earlier blocks."""
    valid = valid_sessions(stream).where("valid").select("session_id")
    blocks = stream.blocks.withColumn("_first", F.col("rows")[0]["id"])
    before = Window.partitionBy("session_id").orderBy("block", "_first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("session_id", "block", "_first", F.size("rows").alias("n")).join(valid, "session_id", "left_semi")
    bases = sizes.select("session_id", "block", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("session_id", "block", "_first")]
    rows = blocks.alias("l").join(bases.alias("r"), same).select("l.session_id", "_base", F.posexplode("l.rows").alias("_i", "x"))
    return rows.select("session_id", (F.col("_base") + F.col("_i")).alias("position"), "x.id", "x.role", F.regexp_replace(answer_text(F.col("x.content")), r"^\s+|\s+$", "").alias("content"), F.timestamp_micros("x.us").alias("created_at"))
