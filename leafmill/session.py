"""Session set-up shared by queries, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

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
    """df, best a written table, marked for broadcast if its rows take at most `most` bytes; beyond that it is joined by a shuffle.

    Only the plan depends on it: both joins give the same rows."""
    size = df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0
    return F.broadcast(df) if size <= (MOST_BYTES if most is None else most) else df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
    return _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="leafmill-"))


_folders: dict[str, str] = {}


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application, so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp()
        os.makedirs(f"{folder}/src")
        shutil.copytree(here, f"{folder}/src/leafmill", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/leafmill-{app}", "zip", f"{folder}/src"))
        shutil.rmtree(f"{folder}/src")
    return spark
