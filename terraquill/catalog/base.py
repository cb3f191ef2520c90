"""Registry, and the tables that stand in for campaign data.

region > nation > market segment is the hierarchy state > LGA > ward; a customer is a settlement, an order a plan row or submission,
a supplier a team, an event a track point. Coordinates are derived from keys, on a plane of 1000 x 1000 metres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("key"), F.col("r_name").alias("state"), F.col("n_name").alias("lga"),
            F.concat_ws("_", "n_name", "c_mktsegment").alias("ward"), F.col("c_name").alias("settlement"),
            F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
            (F.col("c_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 91 % 1000).cast("double").alias("y"),
        )
    )


SETTLEMENTS = """settlements AS (
  SELECT c_custkey AS key, r_name AS state, n_name AS lga, n_name || '_' || c_mktsegment AS ward, c_name AS settlement,
         c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment,
         CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 40).alias("team"), "event_type", "value",
        (F.col("event_id") * 53 % 1000).cast("double").alias("x"), (F.col("event_id") * 17 % 1000).cast("double").alias("y"),
    )


TRACKS = """tracks AS (
  SELECT event_id, ts, user_id % 40 AS team, event_type, value,
         CAST(event_id * 53 % 1000 AS DOUBLE) AS x, CAST(event_id * 17 % 1000 AS DOUBLE) AS y FROM events)"""

STATUSES = ("Visited", "Not Yet Visited", "Not Visited")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plan rows: settlement key, day list, team list, status, year of the round."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("plan"), F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("round"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("Day "), k % 4 + 1, F.lit(", "), k % 3 + 1)).alias("days"),
        F.concat(k % 9, F.lit("/"), k % 31).alias("teams"),
        F.when(F.col("o_orderstatus") == "F", "Visited").when(F.col("o_orderstatus") == "O", "Not Yet Visited").otherwise("Not Visited").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
    )


PLANS = """plans AS (
  SELECT o_orderkey AS plan, o_custkey AS key, CAST(year(o_orderdate) AS INTEGER) AS round,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Day ' || (o_orderkey % 4 + 1) || ', ' || (o_orderkey % 3 + 1) END AS days,
         (o_orderkey % 9) || '/' || (o_orderkey % 31) AS teams,
         CASE o_orderstatus WHEN 'F' THEN 'Visited' WHEN 'O' THEN 'Not Yet Visited' ELSE 'Not Visited' END AS status,
         o_totalprice AS price, o_orderpriority AS priority FROM orders)"""
