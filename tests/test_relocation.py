"""Moves within wards, and crowds at one place, against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import geometry as G
from terraquill.operators import relational, relocation, spatial, tables, tessellation

WARDS = [(1, 0.0, 0.0, 500.0, 1000.0), (2, 500.0, 0.0, 1000.0, 1000.0)]
EXTENTS = [(1, 100.0, 100.0, 200.0, 300.0), (2, 700.0, 800.0, 900.0, 900.0)]


def boxes(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name} long, a double, b double, c double, d double")
    return df.select(name, G.box(*(F.col(c) for c in "abcd")).alias(f"{name}_ring"))


def moved(rows, order, extents):
    """The rule, one point at a time."""
    inside = lambda p, box: box[1] <= p[0] < box[3] and box[2] <= p[1] < box[4]
    taken, out = [], {}
    free = lambda p: not any(0 < math.dist(p, q) < S.MIN_DISTANCE for q in taken)
    for k, x, y, flag in sorted(rows, key=lambda r: order[r[0]]):
        out[k] = (x, y)
        if not flag or x is None:
            continue
        home = next((w for w in WARDS if inside((x, y), w)), None)
        around = [(x + i * S.SHIFT_DISTANCE, y + j * S.SHIFT_DISTANCE) for i, j in relocation.DIRECTIONS]
        spots = [(x, y)] + [p for p in around if home and inside(p, home)]
        spot = next(filter(free, spots), None)
        if spot:
            taken.append(spot)
            out[k] = spot
        elif extents:
            centres = [((e[1] + e[3]) / 2, (e[2] + e[4]) / 2) for e in extents]
            out[k] = min(centres, key=lambda c: math.dist(c, (x, y)))
    return out


@pytest.mark.parametrize("extents", [EXTENTS, []])
def test_moves_are_those_of_one_point_at_a_time(spark, extents):
    rng = random.Random(4)
    rows = [(k, rng.uniform(-50, 1000), rng.uniform(0, 1000), rng.random() < 0.9) for k in range(60)]
    rows += [(100 + k, rng.uniform(480, 520), rng.uniform(480, 520), True) for k in range(40)]  # a crowd on a ward's edge
    rows += [(200, 300.0, 300.0, True), (201, 300.0, 300.0, True), (202, None, 1.0, True)]
    df = spark.createDataFrame(rows, "key long, x double, y double, too_near boolean")
    order = {r.key: r.o for r in df.select("key", relocation._order("key").alias("o")).collect()}
    got = relocation.move_within_wards(df.repartition(3), "key", boxes(spark, WARDS, "ward"), "ward", "ward_ring", boxes(spark, extents, "extent"), "extent", "extent_ring")
    assert got.columns == [*df.columns, "x_new", "y_new"]
    got = {r.key: (r.x_new, r.y_new) for r in got.collect()}
    want = moved(rows, order, extents)
    assert got.keys() == want.keys()
    for k, p in want.items():
        assert got[k] == (pytest.approx(p) if None not in p else p), k
    assert len({p for k, p in want.items() if p != next((r[1], r[2]) for r in rows if r[0] == k)}) > 5


def test_nothing_to_move(spark):
    df = spark.createDataFrame([], "key long, x double, y double, too_near boolean")
    args = boxes(spark, WARDS, "ward"), "ward", "ward_ring", boxes(spark, EXTENTS, "extent"), "extent", "extent_ring"
    assert relocation.move_within_wards(df, "key", *args).collect() == []


def test_a_crowd_at_one_place_settles_in_few_rounds(spark, monkeypatch):
    """Three thousand points at one place, and two places in each other's way: as many rounds as places, whatever the number of points."""
    saved = []
    save = tables.Rounds.save
    monkeypatch.setattr(tables.Rounds, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    rows = [(k, 250.0, 250.0, True) for k in range(3000)] + [(5000 + k, 280.0, 250.0, True) for k in range(40)] + [(6000, 265.0, 280.0, True)]
    df = spark.createDataFrame(rows, "key long, x double, y double, too_near boolean").repartition(3)
    order = {r.key: r.o for r in df.select("key", relocation._order("key").alias("o")).collect()}
    found = relocation.move_within_wards(df, "key", boxes(spark, WARDS, "ward"), "ward", "ward_ring", boxes(spark, EXTENTS, "extent"), "extent", "extent_ring")
    got = {r.key: (r.x_new, r.y_new) for r in found.collect()}
    assert got == {k: pytest.approx(p) for k, p in moved(rows, order, EXTENTS).items()}
    assert sum(n.startswith("turn") for n in saved) <= 12


@pytest.mark.parametrize("farthest", [False, True])
def test_neighbours_of_crowds(spark, farthest):
    rng = random.Random(8)
    places = [(rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(25)] + [(0.0, 0.0), (50.0, 0.0), (-50.0, 0.0)]
    rows = [(k, *rng.choice(places)) for k in range(90)] + [(200, 9e3, 9e3), (201, None, 1.0), (202, None, None)]
    df = spark.createDataFrame(rows, "key long, x double, y double").repartition(3)
    got = {r.key: (r.n_near, r.near_key, r.distance) for r in spatial.neighbours(df, 60.0, "key", farthest=farthest).collect()}
    for k, x, y in rows:
        near = [] if x is None else [(math.dist((x, y), (p, q)), o) for o, p, q in rows if o != k and p is not None and math.dist((x, y), (p, q)) <= 60]
        best = min(near, key=lambda v: (-v[0] if farthest else v[0], v[1]), default=(None, None))
        assert got[k] == (len(near), best[1], pytest.approx(best[0]) if near else None), k


def test_dispersion_is_that_of_all_pairs(spark):
    """Each round against a loop over all pairs, with crowds at some places."""
    rng = random.Random(3)
    places = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(30)]
    rows = [(k, *rng.choice(places)) for k in range(60)] + [(100 + k, 50.0, 50.0) for k in range(30)]
    df = spark.createDataFrame(rows, "key long, x double, y double")
    angle = {r.key: r.a for r in df.select("key", (F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(3600)) * math.pi / 1800).alias("a")).collect()}
    at = {k: (x, y) for k, x, y in rows}
    for n in (1, 2, 3):
        new = dict(at)
        for k, p in at.items():
            d, o = min(((math.dist(p, q), j) for j, q in at.items() if j < k and math.dist(p, q) < S.MIN_DISTANCE), default=(None, None))
            if o is not None:
                q = at[o]
                dx, dy = ((p[0] - q[0]) / d, (p[1] - q[1]) / d) if d else (math.cos(angle[k]), math.sin(angle[k]))
                new[k] = (q[0] + S.TARGET_DISTANCE * dx, q[1] + S.TARGET_DISTANCE * dy)
        at = new
        got = {r.key: (r.x_new, r.y_new) for r in tessellation.disperse(df, "key", rounds=n).collect()}
        assert got == {k: pytest.approx(p, abs=1e-6) for k, p in at.items()}


def test_duplicate_flags(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, "a", None), (4, "a", None), (5, None, None), (6, "b", 1.0)]
    df = spark.createDataFrame(rows, "id long, x string, y double")
    flags = lambda nulls: {r.id: r.f for r in relational.duplicate_flag(df, ["x", "y"], "twice", "f", ignore_nulls=nulls).collect()}
    assert flags(True) == {1: "twice", 2: "twice", 3: None, 4: None, 5: None, 6: None}
    assert flags(False) == {1: "twice", 2: "twice", 3: "twice", 4: "twice", 5: None, 6: None}
