"""Pages below a page of a tree, in breadth-first order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import shared_folder


def below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, level): the roots (node) and all that is reached from them over edges (parent, child), each at its least level.

    One join a level, each level a table of its own in the shared folder; ends where nothing new is found, so that cycles end too."""
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/leafmill/crawl-{uuid.uuid4().hex}"
    new, level = roots.select("node").distinct().withColumn("level", F.lit(0)), 0
    seen = new.limit(0)
    while True:
        new.write.parquet(f"{folder}/{level}")
        new = spark.read.schema(seen.schema).parquet(f"{folder}/{level}")
        if new.isEmpty():
            return seen
        seen, level = seen.unionByName(new), level + 1
        new = new.join(edges, new["node"] == edges["parent"]).select(F.col("child").alias("node")).where("node is not null").distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level))
