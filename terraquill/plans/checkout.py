"""Checked-out settlement lists on their way back into the table of all settlements: a gate of flags, then an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.operators.tables import Rounds

MAJOR = "Major Flag"


def gate(reviewed: DataFrame, by: str = "state", level: str = "flag_level") -> tuple[DataFrame, DataFrame]:
    """(passed, held): a state of which any settlement has a major flag is held back as a whole, with all its rows, so that it can be mended and sent again.
    A null state is a state of its own. Only the names of the states held back meet the rows."""
    bad = reviewed.where(F.col(level) == MAJOR).select(F.col(by).alias("_by")).distinct()
    on = F.col(by).eqNullSafe(F.col("_by"))
    return reviewed.join(bad, on, "left_anti"), reviewed.join(bad, on, "left_semi")


def upsert(rows: DataFrame, path: str, key: str, by: str = "state") -> None:
    """Puts the rows into the Parquet table at ``path``, partitioned by ``by``: of a key that a touched partition has already, the new row stands; other rows stay.

    Keys are unique in ``rows``, and a row without a key is an error. Only the partitions that the rows touch are read and written anew, through a written copy, since a table can't be
    read while it is overwritten. A repeated call changes nothing, and a call that fails on the way leaves the table as it was. Columns are those of ``rows``; what the table
    has besides them is dropped, what it lacks is null.
    """
    spark = rows.sparkSession
    keys = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if not keys.isEmpty():
        raise ValueError(f"{key} must be unique and present")
    rounds = Rounds(spark, "upsert")
    fresh = rounds.save(rows, "fresh")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = fresh
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        table = spark.read.option("mergeSchema", "true").parquet(path)
        touched = fresh.select(F.col(by).alias("_by")).distinct()
        old = table.join(touched, table[by].cast("string").eqNullSafe(F.col("_by").cast("string")), "left_semi").join(fresh.select(key), key, "left_anti")
        old = old.select(*(F.col(c).cast(t).alias(c) if c in old.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
        merged = rounds.save(fresh.unionByName(old), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    rounds.drop("")


def synchronize(reviewed: DataFrame, path: str, key: str, by: str = "state", level: str = "flag_level") -> DataFrame:
    """Upserts the states without a major flag; gives the rows held back."""
    passed, held = gate(reviewed, by, level)
    if not passed.isEmpty():
        upsert(passed, path, key, by)
    return held
