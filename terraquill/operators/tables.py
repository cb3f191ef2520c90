"""Intermediate tables of operators that take several rounds, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its own; a cluster is
    refused, since no folder is known that all of its machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terraquill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Rounds:
    """Tables of one operator call. A written table cuts the lineage, so that a lost executor costs only its own tasks; the tables
    of a round go when the operator drops them, and what a result still reads when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/terraquill/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        if not self.marked:
            files, root = self._at("")
            self.marked = files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._at(name)
            files.delete(path, True)
