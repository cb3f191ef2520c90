"""Voronoi cells, unions, overlays and target areas against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.functions.trapezoids import trapezoids
from terraquill.operators import overlay, spatial, voronoi
from terraquill.plans import target_area

Point = tuple[float, float]


def area(rings) -> float:
    return sum(abs(clip.signed_area(r)) for r in rings)


def square(x: float, y: float, side: float) -> list[Point]:
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def as_rings(polygon) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon]


def plain_cell(seed: Point, others, envelope: list[Point]) -> list[Point]:
    """Cut by every other seed in turn."""
    ring = envelope
    for o in others:
        a, b = o[0] - seed[0], o[1] - seed[1]
        if ring and (a or b):
            ring = clip._cut(ring, a, b, (o[0] ** 2 + o[1] ** 2 - seed[0] ** 2 - seed[1] ** 2) / 2)
    return ring


def crowds() -> list[Point]:
    rng = random.Random(9)
    places = {(rng.gauss(100, 2), rng.gauss(120, 2)) for _ in range(90)} | {(rng.gauss(850, 0.01), rng.gauss(900, 0.01)) for _ in range(60)}
    places |= {(400.0 + 20 * i, 500.0 + 20 * j) for i in range(5) for j in range(5)} | {(950.0, 20.0), (1200.0, 500.0), (0.0, 0.0)}
    # Seeds on a circle around one: a cell of many corners.
    places |= {(700 + 60 * math.cos(k / 30 * math.pi), 300 + 60 * math.sin(k / 30 * math.pi)) for k in range(60)} | {(700.0, 300.0)}
    return sorted(places)


def test_cells_are_those_of_all_seeds(spark):
    places = crowds()
    rows = [(k, *p) for k, p in enumerate(places)] + [(900, *places[3]), (901, *places[3]), (902, None, 1.0)]
    cells = voronoi.voronoi_cells(spark.createDataFrame(rows, "key long, x double, y double").repartition(3), "key", (0.0, 0.0, 1000.0, 1000.0))
    got = {r.key: r.area for r in cells.select("key", G.area(F.col("ring")).alias("area")).collect()}
    assert set(got) == set(range(len(places)))
    for k, p in enumerate(places):
        assert got[k] == pytest.approx(area([plain_cell(p, places, square(0, 0, 1000))]), abs=1e-5), k


def test_finite_cells(spark):
    """Hulls of the finite corners in 110 % of the box, per group; groups of one place, of places on one line, and without place."""
    places = crowds()
    rows = [(k, "ab"[k % 2], *p) for k, p in enumerate(places)] + [(900 + k, "line", float(k), 2.0 * k) for k in range(5)] + [(950, "one", 3.0, 3.0), (951, None, 1.0, 1.0), (952, "a", None, 1.0)]
    found = voronoi.finite_cells(spark.createDataFrame(rows, "key long, state string, x double, y double"), "key", "state")
    got = {r.key: r.area for r in found.select("key", G.area(F.col("ring")).alias("area")).collect()}
    want = {}
    for s in (0, 1):
        mine = [p for k, p in enumerate(places) if k % 2 == s]
        xs, ys = [p[0] for p in mine], [p[1] for p in mine]
        wide, high = max(xs) - min(xs), max(ys) - min(ys)
        far = voronoi.INFINITE * max(wide, high)
        huge = [(min(xs) - far, min(ys) - far), (max(xs) + far, min(ys) - far), (max(xs) + far, max(ys) + far), (min(xs) - far, max(ys) + far)]
        x0, y0, x1, y1 = min(xs) - wide / 10, min(ys) - high / 10, max(xs) + wide / 10, max(ys) + high / 10
        for k, p in enumerate(places):
            if k % 2 == s:
                ring = [q for q in plain_cell(p, mine, huge) if max(abs(q[0] - p[0]), abs(q[1] - p[1])) < 0.99 * far]
                cut = clip.clip_ring(ring, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) if len(ring) > 2 else []
                if area([cut]) > 1e-9:
                    want[k] = area([cut])
    assert set(got) == set(want)
    for k, a in want.items():
        assert got[k] == pytest.approx(a, rel=1e-5, abs=1e-5), k


def stars(n: int, seed: int) -> list[list[Point]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.uniform(0, 300), rng.uniform(0, 300)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 9)))
        out.append([(x + r * math.cos(a), y + r * math.sin(a)) for a, r in ((a, rng.uniform(5, 70)) for a in turns)])
    return out


def test_trapezoids():
    assert area(trapezoids([[square(0, 0, 10), square(2, 2, 3)]])) == pytest.approx(91)
    assert area(trapezoids([[square(0, 0, 10)], [square(5, 5, 10)], [square(15, 5, 5)], [square(1, 1, 2)]])) == pytest.approx(200)
    assert area(trapezoids([[[(0, 0), (4, 4), (8, 0), (8, 8), (0, 8)]]])) == pytest.approx(48)
    assert trapezoids([[[(0, 0), (0, 5), (0, 9)]], []]) == []


def test_union(spark, monkeypatch):
    """Stars that overlap, nested and touching squares, a frame and its hole's filling, copies, null and empty rings; few pieces to a tile, so that crowded tiles split."""
    shapes = [("star", [r]) for r in stars(40, 5)] + [("nest", [square(10 * k, 10 * k, 100 - 20 * k)]) for k in range(4)]
    shapes += [("touch", [square(100 * i, 0, 100)]) for i in range(3)] + [("frame", [square(0, 0, 90), square(20, 20, 30)]), ("frame", [square(20, 20, 30)])] + [("copy", [square(5, 5, 50)])] * 200
    shapes += [("crowd", [square(k / 7, k / 9, 20)]) for k in range(150)] + [("none", None), ("none", []), (None, [square(-30, -30, 10)])]
    df = spark.createDataFrame([(c, p if not p else as_rings(p), k) for k, (c, p) in enumerate(shapes)], f"code string, rings {overlay.RINGS}, id long").repartition(4)
    monkeypatch.setattr(overlay, "MOST", 20)
    rows = {r.code: r for r in overlay.dissolve(df, ["code"], "rings", 40.0, "id").collect()}
    for code in {c for c, _ in shapes}:
        mine = [p for c, p in shapes if c == code and p]
        assert rows[code].area == pytest.approx(area(trapezoids(mine)), rel=1e-9), code
        assert rows[code].area == pytest.approx(area([[(p["x"], p["y"]) for p in r[:-1]] for r in rows[code].rings]), rel=1e-9)
    assert rows["touch"].area == pytest.approx(30_000) and rows["nest"].area == pytest.approx(10_000) and rows["frame"].area == pytest.approx(8100) and rows["copy"].area == pytest.approx(2500)
    assert rows["none"].area == 0 and rows["none"].rings == [] and rows["copy"].n_parts == 200 and rows[None].area == pytest.approx(100)
    assert overlay.dissolve(df.limit(0), ["code"], "rings", 40.0).count() == 0


def test_overlay_of_any_polygons(spark):
    a, b = [[r] for r in stars(25, 6)], [[r] for r in stars(25, 7)]
    a += [[square(0, 0, 200), square(40, 40, 100)]]
    b += [[square(50, 50, 20)], [square(30, 30, 60)], [square(-50, -50, 600), square(0, 0, 300)], [square(500, 500, 9)]]
    frame = lambda d, i, r: spark.createDataFrame([(k, as_rings(p)) for k, p in enumerate(d)], f"{i} long, {r} {overlay.RINGS}")
    found = overlay.overlay(frame(a, "i", "p"), frame(b, "j", "q"), "p", "q", 70.0)
    got = {(r.i, r.j): r.area for r in found.groupBy("i", "j").agg(F.sum("piece_area").alias("area")).collect()}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            both = area(trapezoids([p])) + area(trapezoids([q])) - area(trapezoids([p, q]))
            assert got.get((i, j), 0.0) == pytest.approx(both, abs=1e-6), (i, j)


def test_grid_of_target_areas(spark):
    """Boxes as areas: cells counted from the corner of all areas of a state and size, small and empty cells left out."""
    shapes = [(1, "s", "Built-up Area", 10, 10, 120), (2, "s", "other", 200, 30, 150), (3, "s", None, 5, 305, 40), (4, "t", "other", 0, 0, 104), (5, "s", "Built-up Area", 135, 12, 5)]
    rows = [(k, s, t, "cell", as_rings([square(x, y, w)]), float(w * w)) for k, s, t, x, y, w in shapes]
    areas = spark.createDataFrame(rows, f"key long, state string, type string, origin string, rings {overlay.RINGS}, area double")
    rng = random.Random(2)
    points = [(rng.uniform(0, 130), rng.uniform(0, 130)) for _ in range(60)] + [(rng.uniform(200, 290), rng.uniform(40, 90)) for _ in range(9)]
    found = target_area.gridded_target_areas(areas, spark.createDataFrame(points, "x double, y double"), "key").collect()
    want = {}
    for k, s, t, x, y, w in shapes:
        size = 50 if t == "Built-up Area" else 100
        same = [v for v in shapes if v[1] == s and (v[2] == "Built-up Area") == (t == "Built-up Area")]
        x0, y0 = min(v[3] for v in same), min(v[4] for v in same)
        cells = {}
        for i in range(9):
            for j in range(9):
                l, b, r, u = max(x, x0 + i * size), max(y, y0 + j * size), min(x + w, x0 + (i + 1) * size), min(y + w, y0 + (j + 1) * size)
                if l < r and b < u and (r - l) * (u - b) > 30:
                    cells[i, j] = ((r - l) * (u - b), sum(l <= p < r and b <= q < u for p, q in points))
        some = {c: v for c, v in cells.items() if v[1] > 2} or cells
        want |= {(k, *c): v for c, v in some.items()}
    got = {(r.key, r.cell_x, r.cell_y): (pytest.approx(r.area), r.buildings) for r in found}
    assert want == got


def test_crowded_cells_are_split(spark, monkeypatch):
    """Nine tenths of the points in one cell: the same pairs, from cells of which none holds much more than the limit; boxes, stars, and polygons that cover many cells."""
    monkeypatch.setattr(spatial, "CROWD", 60)
    monkeypatch.setattr(spatial, "MAX_CELLS", 30)
    rng = random.Random(12)
    points = [(k, rng.uniform(100, 149), rng.uniform(100, 149)) for k in range(1800)] + [(5000 + k, rng.uniform(-50, 400), rng.uniform(-50, 400)) for k in range(200)] + [(9000, 120.0, 120.0), (9001, None, 3.0)]
    shapes = [square(100 + 5 * i, 100 + 5 * j, 5) for i in range(9) for j in range(9)] + stars(30, 3) + [square(-100, -100, 450), square(120, 120, 0.5)]
    df = spark.createDataFrame(points, "key long, x double, y double").repartition(4)
    polygons = spark.createDataFrame([(k, as_rings([r])[0]) for k, r in enumerate(shapes)], f"shape long, ring {clip.RING}")
    pairs = {a: {(r.key, r.shape) for r in spatial.points_in_polygons(df, polygons, "ring", adaptive=a).collect()} for a in (False, True)}
    holds = df.join(polygons, G.contains(F.col("ring"), F.col("x"), F.col("y"))).select("key", "shape").collect()
    assert pairs[False] == pairs[True] == {tuple(r) for r in holds} and len(holds) > 3000
    crowds = spatial.crowded_cells(df, "x", "y", 50.0)
    placed = df.where("x is not null").withColumns({"cell_x": G.cell(F.col("x"), 50.0), "cell_y": G.cell(F.col("y"), 50.0)})
    below = lambda rows, d: rows.withColumns({"cell_x": G.cell(F.col("x"), 50.0 / 8**d), "cell_y": G.cell(F.col("y"), 50.0 / 8**d)})
    sizes = sorted(r["count"] for r in spatial._split(placed, crowds, below).groupBy("depth", "cell_x", "cell_y").count().collect())
    assert sizes[-1] <= 60 and sum(sizes) == len(points) - 1
