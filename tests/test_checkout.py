"""The checkout gate and its upsert, and column profiles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terraquill import roles
from terraquill.plans import checkout

SCHEMA = "key string, state string, name string, flag_level string"


def test_a_repeated_sync_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/settlements"
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("key", "state", "name").collect())
    first = spark.createDataFrame([("a", "Kano", "old", None), ("b", "Kano", "stays", None), ("c", "Yobe", "other", "Minor Flag"), ("d", None, "nowhere", None)], SCHEMA)
    assert checkout.synchronize(first, path, "key").count() == 0
    before = read()
    assert before == [("a", "Kano", "old"), ("b", "Kano", "stays"), ("c", "Yobe", "other"), ("d", None, "nowhere")]
    second = spark.createDataFrame([("a", "Kano", "new", "Minor Flag"), ("e", "Kano", "more", None), ("c", "Yobe", "bad", "Major Flag"), ("f", "Yobe", "held too", None), ("d", None, "moved", None)], SCHEMA)
    for _ in range(2):
        held = checkout.synchronize(second, path, "key")
        assert sorted(r.key for r in held.collect()) == ["c", "f"]
        assert {r[0]: r[2] for r in read()} == {"a": "new", "b": "stays", "c": "other", "d": "moved", "e": "more"}
    # More columns than before, and nothing to write.
    third = spark.createDataFrame([("g", "Yobe", "g", None, 3)], SCHEMA + ", size int")
    checkout.synchronize(third, path, "key")
    assert {(r.key, r.size) for r in spark.read.option("mergeSchema", "true").parquet(path).where("state = 'Yobe'").collect()} == {("c", None), ("g", 3)}
    assert checkout.synchronize(third.limit(0), path, "key").count() == 0 and len(read()) == 6


def test_keys_must_be_unique(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Kano", "x", None), ("a", "Yobe", "y", None)], SCHEMA)
    with pytest.raises(ValueError):
        checkout.upsert(rows, f"file://{tmp_path}/t", "key")
    with pytest.raises(ValueError):
        checkout.upsert(rows.limit(1).withColumn("key", F.lit(None).cast("string")), f"file://{tmp_path}/t", "key")


def test_profile_reads_all_roles_from_one_aggregate(spark):
    u = "0b0f1c9e-3a5d-4c1e-9a77-0123456789ab"
    rows = [(1.25, 3.5, 7.0, "a_b_c", u, "Visited", " visited ", None), (None, 3.75, 8.0, "d_e_f_g", None, "not visited", "", None), (1.5, 4.0, 9.0, "h_i_j", u, "Not Yet Visited", "not found", None)]
    df = spark.createDataFrame(rows, "lat double, lon double, y double, code string, id string, visits string, round_1 string, nothing string")
    p = roles.profile(df)
    assert p.decimals == {"lat", "lon"}  # y has whole numbers only, lat has two decimals somewhere
    assert p.coordinates() == roles.Coordinates("lat", "lon")
    assert (p.unique_column(), p.uuid_column(), p.visitation_column()) == (roles.unique_column(df), roles.uuid_column(df), roles.visitation_column(df)) == ("code", "id", "visits")
    assert p.round_columns() == roles.round_columns(df) and "round_1" in p.round_columns()
    with pytest.raises(roles.NotFoundError):
        roles.profile(df.drop("lon")).coordinates()
    empty = roles.profile(df.limit(0))
    assert empty.coordinates() == roles.Coordinates(None, None) and empty.unique_column() is None and empty.round_columns() == []
    odd = roles.profile(spark.createDataFrame([(1.123, "x")], "`a.b` double, `c d` string"))
    assert odd.decimals == {"a.b"}
