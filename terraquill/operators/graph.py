"""Connected components by alternating large and small stars, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its
    own; a cluster is refused, since no folder is known that all of its machines share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terraquill-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b)."""
    links, last = edges.where("a != b"), None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))
        links = cut_lineage(large.join(low, "a").select(F.inline(pairs)).where("a != b").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            low = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
            return low.unionByName(low.select(F.col("component").alias("id"), "component").distinct())
        last = state
