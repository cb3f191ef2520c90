"""Ward plans, archives, GeoPackages and database tables."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from terraquill.functions import geometry as G
from terraquill.roles import DataError
from terraquill.sources import archives, files


def plan(*rows: str) -> str:
    return "\n".join(rows) + "\n"


def settlement(lga: str, ward: str, name: str, population: str = "10") -> str:
    cells = [""] * 18
    cells[0], cells[3], cells[5], cells[8], cells[12], cells[15] = "KB", lga, ward, name, population, "7"
    return ",".join(cells)


HEADER = ",".join(f"c{k}" for k in range(18))


def test_ward_plans(spark, tmp_path):
    gap = " ,," + "," * 15
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("KB/a.csv", plan(HEADER, settlement("L1", "W1", " A "), settlement("L1", "W1", "B", "x"), gap, gap, "Special Place,Type", "Market X,market", ",school"))
        z.writestr("KB/b.csv", plan(HEADER, settlement("L1", "W2", "C"), "Special Place,Type", "Mosque,mosque"))
        z.writestr("KB/c.csv", plan(HEADER, gap, "Special Place,Type", "Lost,church"))
        z.writestr("KB/d.csv", plan(HEADER))
        z.writestr("KB/e.csv", plan(HEADER, settlement("L2", "W3", "D")))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("KB—L1.zip", inner.getvalue())
    rows = archives.plan_rows(spark, f"file://{tmp_path}/all.zip")
    settlements, special = archives.ward_plans(rows)
    assert sorted((r.lga, r.ward, r.settlement, r.population, r.team, r.days) for r in settlements.collect()) == [
        ("L1", "W1", "A", 10.0, "7", ""), ("L1", "W1", "B", 0.0, "7", ""), ("L1", "W2", "C", 10.0, "7", ""), ("L2", "W3", "D", 10.0, "7", "")
    ]
    assert sorted((r.lga, r.ward, r.special_place, r.type) for r in special.collect()) == [("L1", "W1", "Market X", "market"), ("L1", "W2", "Mosque", "mosque")]
    names = spark.createDataFrame([("a/KB — Argungu.zip",), ("Bagudo.csv",), (None,)], "n string").select(archives.lga_of_file(F.col("n"))).collect()
    assert [r[0] for r in names] == ["Argungu", "Bagudo", None]


def test_archive_contents(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x/a.csv", "p,q\n1,2\n\n3,4\n")
        z.writestr("x/b.csv", "p,q\n5,6\n")
        z.writestr("x/readme.txt", "no data")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("state/One.zip", inner.getvalue())
        z.writestr("state/Broken.zip", b"not an archive")
        z.writestr("flat.csv", "p\n1\n")
        z.writestr("empty.csv", "")
    got = {r.dataset: (r.files, r.records) for r in archives.archive_contents(spark, f"file://{tmp_path}/all.zip").collect()}
    assert got == {"One": (2, 3), "Broken": (0, 0), "flat.csv": (1, 1), "empty.csv": (1, 0)}


def test_geopackages_round_trip(spark, tmp_path):
    rows = [("A", k, float(k)) for k in range(25)] + [("B", 1, 2.0), (None, 3, 4.0)]
    df = spark.createDataFrame(rows, "lga string, n int, s double")
    df = df.select("lga", "n", F.when(F.col("n") != 3, G.box(F.lit(0.0), F.lit(0.0), F.col("s"), F.lit(2.0))).alias("ring"))
    made = archives.geopackages(df, "lga", "ring", 'la"yer', rows=10).collect()
    assert sorted({r.name for r in made}) == ["A", "B", "none"] and sum(r.name == "A" for r in made) > 1
    got = []
    for k, r in enumerate(made):
        (tmp_path / f"{k}.gpkg").write_bytes(r.content)
    for k in range(len(made)):
        layer = files.read_geopackage(spark, f"file://{tmp_path}/{k}.gpkg").withColumn("rings", files.decode_wkb(F.col("geometry")))
        got += [(r.c.get("lga"), int(r.c["n"]), r.a) for r in layer.select(F.col("cells").alias("c"), G.area(F.col("rings")[0]).alias("a")).collect()]
    want = [(a, n, None if n == 3 else 2.0 * s) for a, n, s in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_database(spark):
    url = "jdbc:derby:memory:wards;create=true"
    df = spark.createDataFrame([("KB", "L1", 1), ("KB", "L2", 2), ("SK", "L1", 3)], "state string, lga string, n int")
    df.write.format("jdbc").options(url=url, dbtable="wards", createTableColumnTypes="state varchar(9), lga varchar(9)").mode("overwrite").save()
    got = archives.read_database(spark, url, "wards", {"state": "KB", "lga": ["L1", "L2"]})
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert "PushedFilters: [*" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(DataError, match="state: XX"):
        archives.read_database(spark, url, "wards", {"state": "XX"})
