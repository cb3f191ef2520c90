"""Every query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from terraquill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_nested_loops(spark):
    for name in ("point_in_polygon", "farthest_within_class", "gridded_tracking", "triangulation", "duplicate_pairs"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_voronoi_fills_the_envelope(spark):
    areas = [r["area"] for r in catalog.QUERIES["voronoi_area"](spark, SF).collect()]
    assert abs(sum(areas) - 1e6) < 1


def test_dispersion_keeps_rows_and_parts_points(spark):
    from terraquill.operators import tessellation

    df = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(9)], "key long, x double, y double")
    rows = tessellation.disperse(df, "key").collect()
    assert len(rows) == 9
    again = tessellation.disperse(df.repartition(5), "key").collect()
    assert sorted(rows) == sorted(again)
    close = sum(math.dist((a.x_new, a.y_new), (b.x_new, b.y_new)) < 65.9 for a in rows for b in rows if a.key < b.key)
    assert close == 0


def test_target_area(spark):
    """Each place once: the piece of its cell that holds the point, or a circle."""
    from pyspark.sql import functions as F

    from terraquill.functions import geometry as G
    from terraquill.operators import tessellation

    points = [(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 90.0, 10.0), (4, 10.0, 90.0), (5, 90.0, 90.0), (6, None, 1.0)]
    s = spark.createDataFrame(points, "key long, x double, y double")
    boxes = [("Built-up Area", 0.0, 0.0, 60.0, 60.0), ("other", 80.0, 0.0, 100.0, 20.0), ("other", 0.0, 60.0, 5.0, 100.0)]
    e = spark.createDataFrame(boxes, "type string, a double, b double, c double, d double").withColumn("ring", G.box(*(F.col(c) for c in "abcd")))
    found = tessellation.target_area(s, e, "key", (0.0, 0.0, 100.0, 100.0), 40.0)
    got = {r.key: (r.type, round(r.area, 3)) for r in found.withColumn("area", F.aggregate("ring", F.lit(0.0), lambda a, r: a + G.area(r))).collect()}
    circle = round(32 * 100.0**2 * math.sin(math.pi / 32), 3)
    assert got == {1: ("Built-up Area", 2500.0), 3: ("other", 400.0), 4: (None, circle), 5: (None, circle)}
    few = tessellation.target_area(s.where("key < 4"), e, "key", (0.0, 0.0, 100.0, 100.0), 40.0).collect()
    assert sorted((r.key, r.type) for r in few) == [(1, None), (3, None)]


def test_standardize_text_on_whole_documents(spark):
    import re

    def standard(text: str | None) -> str | None:
        if text is None:
            return None
        runs = re.sub(r"[^\W\d_]+", lambda m: m[0][0].title() + m[0][1:], text.strip(" ").lower())
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", runs) or None

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["name"] for r in catalog.QUERIES["standardize_text"](spark, SF).collect()}
    assert got == {k: standard(t) for k, t in texts.items()}


#: Pairs with four scores, worked out by hand from the definitions (twice the common letters over all letters).
SCORES = (
    ("this is a test", "this is a test!", 97, 100, 100, 100),
    ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 91, 93, 100, 100),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 84, 100, 84, 100),
    ("yankees", "new york yankees", 61, 100, 61, 100),
    ("abcd", "abcd", 100, 100, 100, 100),
    ("abcd", "wxyz", 0, 0, 0, 0),
)


def test_fuzzy_scores(spark):
    from terraquill.functions import fuzzy

    names = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")
    for a, b, *want in SCORES:
        assert [round(fuzzy.SCORES[n](a, b)) for n in names] == want

    def common(a: str, b: str) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    like = lambda a, b: 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0
    rows = catalog.QUERIES["fuzzy_scores"](spark, SF).collect()
    assert len(rows) == 199 and len({r.token_set_ratio for r in rows}) > 5
    for r in rows:
        x, y = (" ".join(sorted(t.lower().split())) for t in (r.a, r.b))
        assert (r.ratio, r.token_sort_ratio) == (round(like(r.a, r.b)), round(like(x, y)))
        short, long = sorted((r.a, r.b), key=len)
        windows = [like(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))]
        assert abs(r.partial_ratio - max(windows)) <= 0.5 + 1e-9


def test_fuzzy_best_match_against_brute_force(spark):
    from pyspark.sql import functions as F

    from terraquill.functions import fuzzy
    from terraquill.operators import matching

    names, refs = ["red ring", "blue widgets", "zzz"], ["red rings", "blue widget", "green bolt"]
    a = spark.createDataFrame([(1, n) for n in names], "block int, name string")
    b = spark.createDataFrame([(1, n) for n in refs], "block int, ref string")
    got = {r["name"]: r["match"] for r in matching.mapping(a, b, "name", "ref", ["block"], 80, matching.scorer("weighted_ratio")).collect()}
    want = {n: fuzzy.best_match(n, refs, 80) for n in names}
    assert got == {n: m for n, m in want.items() if m}
    assert a.select(fuzzy.levenshtein_score(F.lit("kitten"), F.lit("sitting"))).first()[0] == pytest.approx(100 * (1 - 3 / 7))


@pytest.mark.parametrize("name, cutoff", [("levenshtein", 92), ("levenshtein", 55), ("ratio", 80), ("token_sort_ratio", 95), ("token_sort_ratio", 60)])
def test_names_within_edits_meet(spark, name, cutoff):
    """Short, repetitive, blank and equal names of two blocks: the pairs that reach the cutoff are those of all pairs."""
    import random

    from pyspark.sql import functions as F

    from terraquill.operators import matching

    score = matching.LEVENSHTEIN if name == "levenshtein" else matching.scorer(name)
    rng = random.Random(cutoff)
    names = {"", " ", "-", "a", "b", "ab", "ba", "aaaaaaaa", "aaaaaaa", "abababab", "babababa", "Ünguwar Ído", "ungwar ido", "Ído Ünguwar"}
    for _ in range(50):
        base = [rng.choice("abc def") for _ in range(rng.randrange(3, 28))]
        names.add("".join(base))
        for _ in range(rng.randrange(1, 4)):
            base[rng.randrange(len(base))] = rng.choice(["", "x", "ab"])
            names.add("".join(base))
    rows = [(k % 2 if len(n) > 2 else b, n) for k, n in enumerate(sorted(names)) for b in (0, 1)]
    a = spark.createDataFrame(rows, "block int, x string").distinct()
    b = a.withColumnRenamed("x", "y")
    hold = lambda df: {tuple(r) for r in df.where(score(F.col("x"), F.col("y")) >= cutoff).select("block", "x", "y").collect()}
    met = matching._pairs(a, b, ["block"], "x", "y", cutoff, score)
    assert hold(met) == hold(a.join(b, "block"))
    if cutoff > 90:
        assert met.count() < a.join(b, "block").count() / 2
