"""Functions, roles, file formats and streams."""

from __future__ import annotations

import io
import math
import random
import sqlite3
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraquill import roles
from terraquill.functions import clip, fuzzy
from terraquill.functions import geometry as G
from terraquill.functions import text as X
from terraquill.operators import graph
from terraquill.operators import relational as L
from terraquill.sources import files
from terraquill.streaming import visits


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=8), st.text("ab c", max_size=8))
def test_ratio_is_the_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    want = 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100
    assert fuzzy.ratio(a, b) == pytest.approx(want)


def test_scores():
    assert fuzzy.token_sort_ratio("new york mets", "mets york new") == 100
    assert fuzzy.token_set_ratio("Ward North", "north ward of town") == 100
    assert fuzzy.partial_ratio("state", "state_name") == 100
    assert fuzzy.best_match("coverage", ["x", "Coverage "], 95) == "Coverage "


def test_title_case_is_pythons(spark):
    names = ["o'neil ward-2a", "ÉCOLE   du nord", "x9y", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.title_case(F.col("n"))).collect()] == [n.title() for n in names]


def test_clipping_conserves_area():
    rng = random.Random(5)
    star = [(500 + r * math.cos(k / 5 * math.pi), 500 + r * math.sin(k / 5 * math.pi)) for k, r in enumerate([400, 150] * 5)]
    total = 0.0
    for i in range(10):
        for j in range(10):
            cell = [(i * 100, j * 100), (i * 100 + 100, j * 100), (i * 100 + 100, j * 100 + 100), (i * 100, j * 100 + 100)]
            if rng.random() < 0.5:
                cell.reverse()
            total += abs(clip.signed_area(clip.clip_ring(star, cell))) if clip.clip_ring(star, cell) else 0
    assert total == pytest.approx(abs(clip.signed_area(star)), rel=1e-9)


def test_projection_and_distance(spark):
    x, y = G.utm(F.lit(3.0), F.lit(0.0), 31)
    row = spark.range(1).select(x.alias("x"), y.alias("y"), G.geodesic(F.lit(9.0), F.lit(7.0), F.lit(9.001), F.lit(7.0)).alias("d"), G.geodesic(F.lit(9.0), F.lit(7.0), F.lit(9.0), F.lit(7.0)).alias("z")).first()
    assert (round(row.x, 3), round(row.y, 3), row.z) == (500000.0, 0.0, 0.0)
    assert row.d == pytest.approx(110.6, abs=0.1)


def test_roles(spark):
    df = spark.createDataFrame([("Kano", "Dala", "Gwale", "S1", "a_b_c_d", 1.5, 2.5)], "state string, lga string, wards string, settlement_name string, unique_col string, latitude double, longitude double")
    assert [roles.admin_column(df, r) for r in ("state", "lga", "ward", "settlement")] == ["state", "lga", "wards", "settlement_name"]
    assert roles.unique_column(df) == "unique_col"
    assert roles.coordinates(df) == roles.Coordinates("latitude", "longitude")
    built, name = roles.with_unique_column(df.drop("unique_col"))
    assert built.first()[name] == "Kano_Dala_Gwale_S1"
    assert roles.admin_column(df.withColumnRenamed("state", "statecode"), "state", required=False) is None
    with pytest.raises(roles.NotFoundError):
        roles.admin_column(df.withColumnRenamed("state", "mandate"), "state")
    with pytest.raises(roles.NotFoundError):
        roles.coordinates(df.withColumn("longitude", F.lit(3).cast("long")))
    assert roles.day_column(["hard2reach", "day_2_cumm", "Day 2"], 2) == "Day 2"
    gaps = spark.createDataFrame([("a_b_c_d",), (None,)], "unique_col string")
    assert roles.unique_column(gaps) is None


def _workbook(rows: list[list[str]]) -> bytes:
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>"
        for i, r in enumerate(rows, 1)
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_archives_and_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("a.csv", "lga,ward\nX,1\nY,\n")
        z.writestr("b.xlsx", _workbook([["lga", "team"], ["Z", "007"], ["", ""]]))
    rows = files.read_tables(spark, f"file://{tmp_path}/all.zip").orderBy("source", "row").collect()
    assert [(r.source, r.lga, r.ward, r.team) for r in rows] == [("a", "X", "1", None), ("a", "Y", None, None), ("b/One", "Z", None, "007")]
    with pytest.raises(files.NotSupported):
        files.read_dataset(spark, "x.docx")


def test_geopackage_and_wkb(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 3.0}, {"x": 0.0, "y": 0.0}]
    blob = b"GP\x00\x01" + struct.pack("<i", 4326) + files.polygon_wkb(ring)
    db = sqlite3.connect(tmp_path / "w.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('wards', 'geom')")
    db.execute("create table wards (name text, geom blob)")
    db.execute("insert into wards values ('A', ?)", (blob,))
    db.commit()
    db.close()
    df = files.read_geopackage(spark, f"file://{tmp_path}/w.gpkg").withColumn("rings", files.decode_wkb(F.col("geometry")))
    row = df.select(F.col("cells")["name"].alias("name"), G.area(F.col("rings")[0]).alias("area")).first()
    assert (row.name, row.area) == ("A", 6.0)


def test_components_and_row_ids(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    assert found == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    ids = L.row_ids(spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")), [F.col("k")]).orderBy("k").collect()
    assert [r.row_id for r in ids] == list(range(1, 1001))
    keys = [(None if k % 9 == 0 else "x" if k % 2 else f"k{k}", k) for k in range(300)]  # text keys, nulls and a skewed key
    ids = L.row_ids(spark.createDataFrame(keys, "a string, b long"), [F.col("a"), F.col("b")]).collect()
    assert [(r.a, r.b) for r in sorted(ids, key=lambda r: r.row_id)] == sorted(keys, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert sorted(r.row_id for r in ids) == list(range(1, 301))


def test_roles_by_words(spark):
    from terraquill import roles

    assert roles.day_word_column(["Sunday", "first day of activity", "Day 2"]) == "first day of activity"
    with pytest.raises(roles.NotFoundError):
        roles.day_word_column(["Daylight"])
    assert roles.keyword_column(["my team list", "Teams", "x"], ("team",)) == "Teams"
    assert roles.keyword_column(["ward code", "the ward"], ("ward",), skip_codes=True) == "the ward"
    assert roles.keyword_column(["a", "b"], ("ward",)) is None and roles.keyword_column([], ("ward",)) is None
    df = spark.createDataFrame([("Visited ", "visited", None, "x", "visited"), ("not found", None, None, "visited", "visited")], "r1 string, r2 string, r3 string, r4 string, coverage string")
    assert roles.round_columns(df, ("R2",)) == ["r1"] and roles.round_columns(df) == ["r1", "r2"]
    assert roles.ranked(["a", "b", "c"], [1, 3, 2]) == ["b", "c", "a"] and roles.ranked(["a"]) == ["a"]


def test_review_helpers(spark):
    from terraquill.functions import rules as R
    from terraquill.functions import text as X
    from terraquill.operators import review
    from terraquill.plans import listing
    from terraquill.roles import DataError

    df = spark.createDataFrame([("pass", "pass", "w", "l", "late"), ("pass", "fail", "w", "l", None)], "lga_review string, ward_review string, ward string, lga string, issue string")
    assert review.passed(df, ["lga", "ward"]).count() == 1 and review.present(df, ["x", "ward", "lga"]).columns == ["ward", "lga"]
    assert [r.line for r in review.issue_lines(df, "issue").collect()] == ["Issues Encountered in w ward, l LGA issues late"]
    codes = spark.createDataFrame([("10000",), ("7;8",), (None,)], "team string")
    assert review.check_team_codes(codes, "team") is codes
    with pytest.raises(DataError, match="10001"):
        review.check_team_codes(codes.union(spark.createDataFrame([("10001",)], "team string")), "team")
    names = spark.createDataFrame([("DIP of Bomo ward, Sabon Gari LGA.pdf",), ("x.pdf",)], "n string").select(X.lga_plan_name(F.col("n")).alias("p")).collect()
    assert tuple(names[0].p) == ("Sabon Gari", "Bomo ward, Sabon Gari LGA.pdf") and names[1].p is None
    numbers = spark.createDataFrame([(-5.0, "-5"), (0.0, "12a"), (None, None)], "set_population double, team_code string")
    got = listing.attribute_checks(numbers).collect()
    assert [(r.WE_set_population, r.WE_team_code) for r in got] == [(None, "Wrong Entry"), (None, None), (None, None)]
    texts = spark.createDataFrame([("12a",), ("-3",), ("x",), (None,)], "x string")
    flags = lambda allow: [r.f for r in texts.select(R.numeric_entry_flag(F.col("x"), allow_zero=allow).alias("f")).collect()]
    assert flags(False) == [None, "Wrong Entry", "Wrong Entry", None] and flags(True) == [None] * 4


def test_listing_frames(spark):
    """Whole-table steps with expected results: standard lists, updates, repairs, global ids, worst actions, team plans."""
    from terraquill.operators import matching as M
    from terraquill.plans import listing

    raw = spark.createDataFrame([(" kano", "DALA", "ang. a", "alh musa", "keep me")], "state string, lga string, ward string, settlement string, eha_guid string")
    row = listing.standardize_list(raw).first()
    assert (row.state, row.ward, row.settlement, row.eha_guid, row.unique_code) == ("Kano", "Anguwar A", "Alhaji Musa", "keep me", "Kano_Dala_Anguwar A_Alhaji Musa")
    people = spark.createDataFrame([(0.0, 30.0, 4.0), (100.0, 20.0, 10.0)], "set_population double, set_target double, number_of_household double")
    assert [tuple(r) for r in listing.repair_population(people).collect()] == [(150.0, 30.0, 4.0), (100.0, 20.0, 10.0)]
    ids = spark.createDataFrame([("a" * 32,), ("bad",), (None,)], "eha_guid string")
    fixed = [r.eha_guid for r in listing.fix_global_ids(ids).collect()]
    assert fixed[0] == "a" * 32 and all(len(x) == 32 for x in fixed) and "bad" not in fixed
    pairs = spark.createDataFrame([(1, 2, "Duplicate Review"), (2, 3, "Duplicate Remove"), (4, 5, "Unlikely Potential Duplicate Review")], "key_a int, key_b int, action string")
    assert {r.key: r.action for r in M.worst_action(pairs, "key").collect()} == {1: "review", 2: "remove", 3: "remove", 4: "potential", 5: "potential"}
    plan = spark.createDataFrame([("8;7", "Day 1, 3"), (None, None)], "team string, days string")
    got = listing.team_plans(plan).collect()
    assert [(r.team, r["Day 1"], r["Day 2"], r["Day 3"]) for r in got] == [("007", "Yes", None, "Yes"), ("008", "Yes", None, "Yes")]


def test_circle(spark):
    ring, area = spark.range(1).select(G.circle(F.lit(1.0), F.lit(2.0), 5.0).alias("r"), G.area(G.circle(F.lit(1.0), F.lit(2.0), 5.0)).alias("a")).first()
    assert len(ring) == 65 and ring[0] == ring[-1] and tuple(ring[0]) == pytest.approx((6.0, 2.0))
    assert all(math.dist(p, (1.0, 2.0)) == pytest.approx(5.0) for p in ring)
    assert area == pytest.approx(32 * 25 * math.sin(math.pi / 32))


def test_one_state(spark):
    from terraquill.plans import listing

    df = spark.createDataFrame([(1, "Kano"), (2, "Kano"), (3, None)], "id int, state string")
    assert listing.one_state(df).count() == 2
    for bad in (df.where("id = 3"), df.union(spark.createDataFrame([(4, "Yobe")], "id int, state string"))):
        with pytest.raises(roles.DataError):
            listing.one_state(bad)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    points = events.select("ts", (F.col("event_id") * 53 % 1000).cast("double").alias("x"), (F.col("event_id") * 17 % 1000).cast("double").alias("y"))
    points.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/in")
    query = visits.first_visits(stream, delay="60 days").writeStream.foreachBatch(visits.merge_visits(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.cell_x, r.cell_y) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.a, r.b) for r in points.select(G.cell(F.col("x"), 50).alias("a"), G.cell(F.col("y"), 50).alias("b")).distinct().collect()}
    assert got == want


def test_geodesic_distances(spark):
    """Published lines: a survey line of 54,972.271 m, a degree of the equator, the quarter meridian, and degrees of a meridian; and points without or nearly without a line."""
    e2 = (2 - 1 / 298.257223563) / 298.257223563

    def meridian(a: float, b: float, n: int = 20_000) -> float:
        at = (math.radians(a + (b - a) * (k + 0.5) / n) for k in range(n))
        return sum(6378137.0 * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5 for p in at) * math.radians(b - a) / n

    lines = [
        (-37 - 57 / 60 - 3.7203 / 3600, 144 + 25 / 60 + 29.5244 / 3600, -37 - 39 / 60 - 10.1561 / 3600, 143 + 55 / 60 + 35.3839 / 3600, 54_972.271),
        (0.0, 0.0, 0.0, 1.0, 111_319.491), (0.0, 10.0, 90.0, 10.0, 10_001_965.729), (0.0, 179.5, 0.0, -179.5, 111_319.491),
        (0.0, 5.0, 1.0, 5.0, 110_574.389), (89.0, 5.0, 90.0, 5.0, meridian(89, 90)), (4.0, 5.0, 14.0, 5.0, meridian(4, 14)), (12.0, 8.0, 12.0, 8.0, 0.0), (12.0, -180.0, 12.0, 180.0, 0.0),
    ]
    df = spark.createDataFrame(lines + [(None, 1.0, 2.0, 3.0, None)], "a double, b double, c double, d double, m double")
    for r in df.withColumn("found", G.geodesic(*(F.col(c) for c in "abcd"))).collect():
        assert (r.found is None and r.m is None) or abs(r.found - r.m) < 0.001, r
    # Opposite points: half the way around, within what the fall-back promises.
    far = spark.createDataFrame([(0.0, 0.0, 0.3, 179.7), (10.0, 20.0, -10.0, -160.0)], "a double, b double, c double, d double")
    for r in far.withColumn("found", G.geodesic(*(F.col(c) for c in "abcd"))).collect():
        assert abs(r.found - 20_003_900) < 100_000
