"""Work that must not grow with copies, crowds or far corners."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.functions import nearest
from terraquill.llm import language_id
from terraquill.operators import overlay, tables, tessellation, voronoi
from terraquill.plans import target_area


def test_copies_of_a_polygon_are_cut_once(spark, monkeypatch):
    """A thousand squares of four forms in two groups: eight reach the tiles, and all are counted."""
    seen = []
    tiled = overlay.tiled
    monkeypatch.setattr(overlay, "tiled", lambda polygons, *rest: seen.append(polygons.count()) or tiled(polygons, *rest))
    x = (F.col("id") % 4) * 5.0
    squares = spark.range(1000).select((F.col("id") % 8 >= 4).alias("code"), G.box(x, x, x + 10, x + 10).alias("ring"))
    got = {r.code: (r.n_parts, r.area) for r in overlay.dissolve(squares, ["code"], "ring", 8.0).collect()}
    assert got == {True: (500, 325.0), False: (500, 325.0)}
    assert seen == [8]


def test_nearest_before_meets_few_pairs(monkeypatch):
    """A crowd of 6,000 points within the radius: brute force, by pairs in proportion to the points (all pairs: 18 million)."""
    rng = np.random.default_rng(5)
    x, y, rank = rng.uniform(0, 60, 6000), rng.normal(30, 9, 6000), rng.permutation(6000)
    x[:500], y[:500] = 7.0, 7.0
    pairs = []
    meet = nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda *a: pairs.append(int(a[5].sum())) or meet(*a))
    distance, before = nearest.nearest_before(x, y, rank, np.arange(6000), 66.0)
    assert sum(pairs) < 100 * 6000
    for k in range(6000):
        d = np.where(rank < rank[k], np.sqrt((x[k] - x) * (x[k] - x) + (y[k] - y) * (y[k] - y)), np.inf)
        best = min(np.flatnonzero(d == d.min()), key=lambda o: rank[o])
        assert (distance[k], before[k]) == ((d[best], best) if d[best] < 66 else (np.inf, -1)), k


def test_crowded_tiles_disperse_like_others(spark, monkeypatch):
    s = spark.range(400).select(F.col("id").alias("key"), (F.col("id") * 37 % 20 * 47.0).alias("x"), (F.col("id") * 91 % 18 * 61.0).alias("y"))
    s = s.unionByName(spark.range(500, 503).select(F.col("id").alias("key"), F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("y")))
    plain = {tuple(r) for r in tessellation.disperse(s, "key", rounds=3).collect()}
    monkeypatch.setattr(tessellation, "CROWDED", 90)
    assert {tuple(r) for r in tessellation.disperse(s, "key", rounds=3).collect()} == plain and len(plain) == 403


def test_only_cells_at_the_envelope_ask_the_tree(spark, monkeypatch):
    """A lattice of 40 x 40: inner cells are right at once, and a far corner asks for few nodes."""
    asked = []
    save = tables.Rounds.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.startswith("asked"):
            asked.append(out.count())
        return out

    monkeypatch.setattr(tables.Rounds, "save", counted)
    points = spark.range(1600).select("id", F.lit("a").alias("g"), (F.col("id") % 40 * 40.0).alias("x"), (F.floor(F.col("id") / 40) * 40.0).alias("y"))
    cells = voronoi.finite_cells(points, "id", "g").select("id", "x", "y", G.area(F.col("ring")).alias("area")).collect()
    inner = [r for r in cells if 0 < r.x < 1560 and 0 < r.y < 1560]
    assert len(inner) == 38 * 38 and all(abs(r.area - 1600) < 1e-6 for r in inner)
    assert sum(asked) < 1600


def broadcasts(spark) -> list[tuple[int, int]]:
    """The execution and the rows of each broadcast so far."""
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for i in (runs.apply(k).executionId() for k in range(runs.size())):
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                rows = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                found += [(i, int(v.get().replace(",", ""))) for v in rows if v.isDefined()]
    return found


def test_settlements_are_never_broadcast(spark, monkeypatch, tmp_path):
    """3,600 settlements in small files: neither they nor their circles, their pieces, their grid or the tree of their places are broadcast by the sizes of files."""
    monkeypatch.setattr(target_area, "PIECES", 100)
    monkeypatch.setattr(target_area, "PLACES", 100)
    x, y = F.col("id") % 60 * 40.0, F.floor(F.col("id") / 60) * 40.0
    spark.range(3600).select(F.col("id").alias("key"), F.lit("s").alias("state"), x.alias("x"), y.alias("y")).write.parquet(f"{tmp_path}/settlements")
    i, j = F.col("id") % 5 * 300.0, F.floor(F.col("id") / 5) * 300.0
    wards = spark.range(25).select(F.lit("s").alias("state"), F.lit("l").alias("lga"), F.col("id").cast("string").alias("ward"), G.box(i, j, i + 300, j + 300).alias("ring"))
    extents = spark.range(25).select(F.array(G.box(i, j, i + 250, j + 250)).alias("rings"), F.lit("Built-up Area").alias("type"))
    known = {e for e, _ in broadcasts(spark)}
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1")  # none by the size of what was shuffled
    try:
        areas = target_area.target_areas(spark.read.parquet(f"{tmp_path}/settlements"), wards, extents, "key", 500.0)
        target_area.gridded_target_areas(areas, spark.range(400).select((F.col("id") % 20 * 9.0).alias("x"), (F.col("id") % 19 * 8.0).alias("y")), "key").collect()
        got = {r.origin: (r.n, r.k) for r in areas.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got["cell"][0] == got["cell"][1] and got["circle"][0] + got["cell"][0] == 3600 and got["cell"][0] > 900
    rows = [n for e, n in broadcasts(spark) if e not in known]
    assert rows and max(rows) < 1800


def test_equally_near_seeds_are_cut_in_one_order():
    """A lattice, whose cells' neighbours are equally near: the same corners, to the last digit, in whatever order the rows come."""
    rng = random.Random(4)
    at = [(float(k), 10.0 + 40 * (k % 9 + 75), 10.0 + 40 * (k // 9 + 31)) for k in range(81)]
    far, found = 1e4 * 17_000, []
    fixed = {"_g": "a", "_x0": 10.0, "_y0": 10.0, "_w": 17_000.0, "_side": 340.0, "_cx": 9, "_cy": 4, "_a": -far, "_b": -far, "_c": far, "_d": far, "_own": True}
    for _ in range(4):
        rng.shuffle(at)
        rings = voronoi._solve_square(pa.Table.from_pylist([fixed | {"_key": k, "_x": x, "_y": y} for k, x, y in at]))
        found.append({r["_key"]: r["_ring"] for r in rings.to_pylist()})
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 81


def test_batches_are_clipped_like_single_rings():
    rng = random.Random(6)
    turn = lambda n, r, x, y: [(x + r * math.cos(k * 2 * math.pi / n), y + r * math.sin(k * 2 * math.pi / n)) for k in range(n)]
    rows = [(turn(rng.randrange(3, 40), rng.uniform(1, 9), rng.uniform(0, 9), 5.0), turn(rng.randrange(3, 7), rng.uniform(1, 9), 5.0, 5.0)[:: rng.choice((1, -1))]) for _ in range(200)]
    rows += [([], rows[0][1]), (rows[0][0], [(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)]), (rows[1][0], [(0.0, 0.0), (9.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])]
    shape = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    got = clip._intersections(*(pa.array([clip._ring(r[i]) for r in rows], shape) for i in (0, 1)))
    assert got.to_pylist() == [clip._ring(clip.clip_ring(a, b)) for a, b in rows]


def test_calibration_holds_few_texts_at_a_time():
    """A thousand texts of 1,000 subwords: the embeddings of all would take 64 MB, and as much again for their shares."""
    rng = np.random.default_rng(2)
    bags = language_id.Bags.of([(rng.integers(0, language_id.BUCKETS, 1000).astype(np.uint16), np.ones(1000, np.int32)) for _ in range(1000)])
    emb, rows = rng.normal(0, 1, (language_id.BUCKETS, language_id.WIDTH)).astype(np.float32), np.arange(0, 1000)
    tracemalloc.start()
    got = bags.means(emb, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000 and (got == bags.take(rows).mean(emb)).all()
