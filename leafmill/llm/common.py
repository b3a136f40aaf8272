"""Shared plumbing of the operators in this folder: tables, written intermediate results, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="leafmill-"))


def filesystem(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path object) of Hadoop for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}-{name}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, cut from its lineage, read with column pruning.

    Unlike executor-local caching it survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables made by written() that no plan reads any more."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/leafmill/" in f:
                fs, p = filesystem(spark, f)
                fs.delete(p, True)


MOST_BYTES = 32 << 20


def row_bytes(schema: StructType) -> Column:
    """About how many bytes a row takes in memory; strings and arrays by their length."""

    def size(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            each = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 8
            return F.greatest(F.size(c), F.lit(0)) * each + 16
        if isinstance(kind, StructType):
            return sum((size(c[f.name], f.dataType) for f in kind), F.lit(16))
        return F.lit(8)

    return sum((size(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(24)).cast("bigint")


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows take at most `most` bytes; beyond that it is joined by a shuffle.

    Only the plan depends on it: both joins give the same rows."""
    size = df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0
    return F.broadcast(df) if size <= (MOST_BYTES if most is None else most) else df.hint("merge")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, parts: int | None = None) -> DataFrame:
    """df with `out`: the sum of `weight` over the earlier rows of the same group, in the given order (which must be total).

    A group may hold any share of the rows: the rows are range partitioned on (group, order), so that a large group is spread over
    many tasks; each task sums its own rows; and only one row per task and group is summed in sequence. The partitioned rows are
    written out once, because range bounds are sampled and a recomputed partition could otherwise differ. Null groups are a group;
    null order values come first. An empty frame gives an empty frame."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_w", weight.cast("bigint")).repartitionByRange(parts, *group, *order).withColumn("_pid", F.spark_partition_id())
    keyed = written(keyed, "ranges")
    within = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("_pid", *group).agg(F.sum("_w").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    a, b = local.alias("a"), bases.alias("b")
    same = F.col("a._pid") == F.col("b._pid")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, same).select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("_local") + F.col("_base")).alias(out))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph: component is the least node reachable. Nodes are bigint.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round points neighbours at the least node they know, so
    a hub with a third of all edges is only ever grouped by an aggregate (min), never collected. Rounds are logarithmic in the
    longest path; each ends in a written table. Stops when a round changes nothing. Edges with a null end are ignored."""
    e = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    nodes = written(e.select("u").union(e.select("v")).distinct(), name + "-nodes")
    stamp = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e.sparkSession, e)
        e = new
        if now == stamp:
            break
        stamp = now
    return nodes.join(e, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
