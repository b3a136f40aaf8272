"""Streams: incremental ingestion without repeated content, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/leafmill/stream-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of its files; a table of one file is read through its folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote."""
    spark = stream.sparkSession
    folder = _folder(spark)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def new_content(stream: DataFrame, key: str = "hash") -> DataFrame:
    """One row for each content key ever seen (keyed state); rows with a null key equal nothing and pass."""
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(stream.where(F.col(key).isNull()))


def new_content_within(stream: DataFrame, at: str, late: str, key: str = "hash") -> DataFrame:
    """new_content() with state that is given up once the watermark is `late` past a key's event time: repeats that come within it are
    dropped, so that the state stays as large as that time's keys; older repeats are left to the stored history."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    once = timed.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key]).drop("_at")
    return once.unionByName(stream.where(F.col(key).isNull()))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type, emitted once the watermark has passed; windows tumble, or slide."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Each user's stretches of events without a pause of `gap`, emitted once the watermark has passed their end."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
