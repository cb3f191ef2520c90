"""Tracks as a stream: the first visit of each cell, and settlement status kept by merging batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.functions import geometry as G


def first_visits(tracks: DataFrame, size: float = 50.0, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """A stream of track points reduced to the first one of each cell; state older than the delay is dropped."""
    cells = tracks.select(F.col(ts).cast("timestamp").alias("ts"), G.cell(F.col("x"), size).alias("cell_x"), G.cell(F.col("y"), size).alias("cell_y"))
    return cells.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["cell_x", "cell_y"])


def hourly_activity(tracks: DataFrame, delay: str = "1 hour", ts: str = "ts", team: str = "team") -> DataFrame:
    """Track points and mean position of each team by hour, once an hour is complete."""
    t = tracks.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", delay)
    return t.groupBy(F.window("ts", "1 hour").alias("hour"), team).agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )


def merge_visits(table: str):
    """For ``foreachBatch``: appends a batch's cells to a table by batch, so that a repeated batch replaces itself."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return merge
