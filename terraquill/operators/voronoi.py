"""Voronoi cells by verified corners: no row ever holds more seeds than its cell has corners.

Most cells are cut at once, by the seeds in their square of a grid and in half a square around it; a corner whose circle through the seed lies in there is right. Squares
that hold more than ``BLOCK`` seeds are split. What is left are cells at the envelope, beside empty land, or in the densest crowds.

For them, seeds are put into a tree of square nodes, each split into 8 x 8 children down to ``LEVELS``. The tree is one table: for every node its
children that hold seeds, each with the outermost of them in eight directions and their number. A cell of a crowd starts as the envelope, cut by the nearest seed in each of
``SECTORS`` directions among its own node's children. A corner of a cell is right if no seed is nearer to it than the cell's own seed. Each round
asks this for all open corners at once: the (at most four) nodes that a corner's circle touches give at most 64 children each. A child's
seed inside the circle cuts the corner off; where none does, a child that touches the circle, and holds more seeds, is asked in turn, ``DEPTH`` levels in one round. So dense places far away
cost a sparse cell a few rows, and border cells are no special case.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.operators.tables import Rounds

LEVELS = 8
SECTORS = 16
#: Seeds that a node should hold for the first cut.
START = 8
DEPTH = 3
#: Seeds of a group to a square of the first grid, on average; seeds with which a square and its surroundings are solved in one task; how often squares are split into 4 x 4.
SQUARE, BLOCK, SPLITS = 64, 1024, 4
#: Questions of one level that are broadcast; the tree, of which a written megabyte may hold 200,000 rows, never is.
ASKED = 100_000
#: What is nearer than this share of the width of the seeds' square is the same place; of a corner's distance, what rounding may leave.
SAME, ROUNDING = 1e-9, 2e-14
#: A corner further away than so many widths counts as infinitely far.
INFINITE = 1e4


def _tree(seeds: DataFrame) -> DataFrame:
    """(_g, level, cx, cy, kx, ky, reps, n): the children (kx, ky) of each node, their outermost seeds and their number. Below the last
    level each seed is a child of its own."""
    last = F.col("level") == LEVELS
    cells = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumns(
        {"kx": _index("_u", F.col("level") + 1), "ky": _index("_v", F.col("level") + 1)}
    )
    groups = ["_g", "level", F.expr("kx div 8").alias("cx"), F.expr("ky div 8").alias("cy"), "kx", "ky", F.when(last, F.col("_x")).alias("sx"), F.when(last, F.col("_y")).alias("sy")]
    sides = [i * F.col("_x") + j * F.col("_y") for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    outer = [F.min(F.struct(v.alias("v"), F.col("_x").alias("x"), F.col("_y").alias("y"))).alias(f"r{k}") for k, v in enumerate(sides)]
    reps = F.array_distinct(F.array(*(F.struct(f"r{k}.x", f"r{k}.y") for k in range(len(sides)))))
    return cells.groupBy(*groups).agg(*outer, F.count("*").alias("n")).select("_g", "level", "cx", "cy", "kx", "ky", reps.alias("reps"), "n")


def _index(unit: str, level: Column) -> Column:
    """The number of a node along one axis, from the place's share of the square's width."""
    n = F.pow(F.lit(8.0), level)
    return F.least(F.floor(F.col(unit) * n), n - 1).cast("long")


def _first_rings(seeds: DataFrame, tree: DataFrame) -> DataFrame:
    """Each seed with the nearest seed in each direction of the smallest node around it that holds enough."""
    counts = tree.groupBy("_g", "level", "cx", "cy").agg(F.sum("n").alias("n")).where((F.col("n") >= START) | (F.col("level") == 0))
    nodes = seeds.select("_g", "_key", "_x", "_y", "_u", "_v", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    nodes = nodes.withColumns({"cx": _index("_u", F.col("level")), "cy": _index("_v", F.col("level"))}).drop("_u", "_v")
    own = nodes.join(counts.drop("n").hint("merge"), ["_g", "level", "cx", "cy"]).groupBy("_g", "_key").agg(F.max(F.struct("level", "cx", "cy", "_x", "_y")).alias("o"))
    met = own.select("_g", "_key", "o.*").join(tree.hint("merge"), ["_g", "level", "cx", "cy"]).select("_g", "_key", "_x", "_y", F.inline("reps"))
    met = met.withColumnsRenamed({"x": "rx", "y": "ry"}).where("rx != _x or ry != _y")
    dx, dy = F.col("rx") - F.col("_x"), F.col("ry") - F.col("_y")
    sector = F.floor(F.atan2(dy, dx) / (2 * math.pi / SECTORS))
    near = met.groupBy("_g", "_key", sector.alias("sector")).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "rx", "ry")).alias("b"))
    near = near.groupBy("_g", "_key").agg(F.collect_list(F.struct(F.col("b.rx").alias("x"), F.col("b.ry").alias("y"))).alias("others"))
    return seeds.join(near, ["_g", "_key"], "left")


def _open_corners(cells: DataFrame) -> DataFrame:
    """(_g, _key, vx, vy, r, level, cx, cy): the nodes that the circles of corners not yet known to be right touch."""
    c = cells.select("_g", "_key", "_x", "_y", "_x0", "_y0", "_w", F.inline(F.filter("_ring", lambda p: ~p["ok"])))
    c = c.select("_g", "_key", "_x0", "_y0", "_w", F.col("x").alias("vx"), F.col("y").alias("vy"), G.planar(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")).alias("r"))
    level = F.floor(F.log(F.col("_w") / (2 * F.col("r"))) / math.log(8)).cast("int")
    c = c.where("r > 0").withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), level)))
    n = F.pow(F.lit(8.0), F.col("level"))

    def along(v: str, low: str) -> Column:
        at = lambda s: F.floor((F.col(v) + s * F.col("r") - F.col(low)) / F.col("_w") * n)
        first, last = F.greatest(at(-1), F.lit(0)), F.least(at(1), n.cast("long") - 1)
        return F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array(F.least(first, n.cast("long") - 1))))

    return c.withColumn("cx", along("vx", "_x0")).withColumn("cy", along("vy", "_y0"))


def _met(frontier: DataFrame, tree: DataFrame) -> DataFrame:
    """The children that cut a corner off (``cuts``) or must be asked in turn (``more``), with the corner and the child's seed nearest to it."""
    met = frontier.join(tree, ["_g", "level", "cx", "cy"])
    near = F.array_min(F.transform("reps", lambda r: F.struct(G.planar(F.col("vx"), F.col("vy"), r["x"], r["y"]).alias("d"), r["x"].alias("x"), r["y"].alias("y"))))
    met = met.withColumn("near", near)
    least = F.col("r") - F.greatest(SAME * F.col("_w"), ROUNDING * F.col("r"))
    side = F.col("_w") / F.pow(F.lit(8.0), F.col("level") + 1)

    def away(v: str, k: str, low: str) -> Column:
        edge = F.col(low) + F.col(k) * side
        return F.greatest(edge - F.col(v), F.col(v) - edge - side, F.lit(0.0))

    touch = F.sqrt(F.pow(away("vx", "kx", "_x0"), 2) + F.pow(away("vy", "ky", "_y0"), 2)) < least
    return met.select("_g", "_key", "vx", "vy", "r", "_x0", "_y0", "_w", "level", "kx", "ky", "near", (F.col("near.d") < least).alias("cuts"), ((F.col("n") > 1) & touch).alias("more")).where("cuts or more")


def _deeper(asked: DataFrame) -> DataFrame:
    down = asked.where("b is null").select("_g", "_key", "vx", "vy", "r", "_x0", "_y0", "_w", F.inline("more"))
    return down.select("_g", "_key", "vx", "vy", "r", "_x0", "_y0", "_w", (F.col("level") + 1).alias("level"), F.col("kx").alias("cx"), F.col("ky").alias("cy"))


def _asked(frontier: DataFrame, tree: DataFrame, rounds: Rounds, name: str) -> tuple[DataFrame, list[str]]:
    """(_g, _key, vx, vy, r, _x0, _y0, _w, b, more): what ``DEPTH`` levels have to say to the corners, once for each corner: the seed ``b`` that cuts it off, or the children to ask
    below these levels. A corner that is cut off asks no further, so that a far corner doesn't list all the seeds in its circle. With the names of the tables of the levels."""
    found, names = [], []
    for k in range(DEPTH):
        n = frontier.limit(ASKED + 1).count()
        if k and not n:
            break
        met = _met(F.broadcast(frontier) if n <= ASKED else frontier.hint("merge"), tree)
        best = F.min(F.when(F.col("cuts"), F.col("near"))).alias("b")
        more = F.collect_list(F.when(F.col("more"), F.struct("level", "kx", "ky"))).alias("more")
        names.append(f"{name}_{k}")
        asked = rounds.save(met.groupBy("_g", "_key", "vx", "vy", "r", "_x0", "_y0", "_w").agg(best, more), names[-1])
        found.append(asked if k + 1 == DEPTH else asked.where("b is not null"))
        frontier = _deeper(asked)
    return reduce(DataFrame.unionByName, found), names


_FLAGGED = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("ok", pa.bool_())]))


def _solve_square(table: pa.Table) -> pa.Table:
    """The rings of a square's own seeds, cut by all seeds in it and around it, nearest first, as far as any can matter."""
    own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
    x, y = (table.column(c).to_numpy() for c in ("_x", "_y"))
    head = table.slice(0, 1).to_pylist()[0]
    x0, y0, w, side = head["_x0"], head["_y0"], head["_w"], head["_side"]
    known = []
    for low, k in ((x0, head["_cx"]), (y0, head["_cy"])):
        first, last = (k - 0.5) * side, (k + 1.5) * side
        known.append((low + first if first > 0 else -math.inf, low + last if last < w else math.inf))
    (left, right), (down, up) = known
    envelope = [(float(head[a]), float(head[b]), False) for a, b in (("_a", "_b"), ("_c", "_b"), ("_c", "_d"), ("_a", "_d"))]
    rings = []
    for k in own.tolist():
        seed = (float(x[k]), float(y[k]))
        away = np.hypot(x - x[k], y - y[k])
        order = np.lexsort((y, x, away))
        ring = clip.cut_flagged(seed, list(zip(x[order].tolist(), y[order].tolist())), envelope, SAME * w, in_order=True)
        out = []
        for px, py, _ in ring:
            r = math.hypot(px - seed[0], py - seed[1])
            out.append({"x": px, "y": py, "ok": px - r >= left and px + r <= right and py - r >= down and py + r <= up})
        rings.append(out)
    kept = table.select(["_g", "_key", "_x", "_y", "_x0", "_y0", "_w"]).take(pa.array(own))
    return kept.append_column("_ring", pa.array(rings, _FLAGGED))


def _solved(seeds: DataFrame, rounds: Rounds, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rings of the seeds in squares that can be solved in one task, and the seeds of crowds that are left (None: there are none)."""
    at = lambda v, low, side, s=0.0: F.floor((F.col(v) - F.col(low)) / F.col(side) + s).cast("long")
    near = lambda v, low: F.explode(F.sequence(at(v, low, "_side", -0.5), at(v, low, "_side", 0.5)))
    own = (at("_x", "_x0", "_side") == F.col("_cx")) & (at("_y", "_y0", "_side") == F.col("_cy"))
    place = ["_g", "_side", "_cx", "_cy"]
    types = {f.name: f.dataType.simpleString() for f in seeds.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + f", _ring {clip.FLAGGED}"
    kept = [*columns, "_a", "_b", "_c", "_d"]
    sized = seeds.withColumn("_side", F.col("_w") * F.least(F.lit(1.0), F.sqrt(SQUARE / F.col("_n"))))
    todo = sized.withColumn("_cx", near("_x", "_x0")).withColumn("_cy", near("_y", "_y0")).select(*kept, *place[1:], own.alias("_own"))
    found = []
    for k in range(SPLITS + 1):
        counts = todo.groupBy(*place).agg(F.count("*").alias("_m"), F.bool_or("_own").alias("_any")).where("_any")
        counts = rounds.save(counts.withColumn("_many", F.col("_m") > BLOCK).select(*place, "_many"), f"squares{k}")
        found.append(todo.join(counts.where("not _many"), place, "left_semi").groupBy(*place).applyInArrow(_solve_square, schema))
        if counts.where("_many").isEmpty():
            return reduce(DataFrame.unionByName, found), None
        crowds = todo.join(counts.where("_many"), place, "left_semi")
        if k == SPLITS:
            return reduce(DataFrame.unionByName, found), crowds.where("_own").select("_g", "_key")
        split = crowds.withColumnsRenamed({"_cx": "_px", "_cy": "_py", "_own": "_mine"}).withColumn("_side", F.col("_side") / 4)
        split = split.withColumn("_cx", near("_x", "_x0")).withColumn("_cy", near("_y", "_y0"))
        split = split.where("_cx div 4 = _px and _cy div 4 = _py and _cx >= 0 and _cy >= 0")
        todo = rounds.save(split.select(*kept, *place[1:], (F.col("_mine") & own).alias("_own")), f"crowds{k}")


def cells_in(seeds: DataFrame, rounds: Rounds) -> DataFrame:
    """The cells of ``seeds``: _g (group), _key, _x, _y, and _a, _b, _c, _d (the group's envelope: x and y from, x and y to). Seeds of one
    group stand at distinct places. Gives _g, _key, _x, _y and _ring, with corners x, y in order."""
    x0, y0 = F.min("_x").alias("_x0"), F.min("_y").alias("_y0")
    square = seeds.groupBy("_g").agg(x0, y0, F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("_w"), F.count("*").alias("_n"))
    square = square.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w") * (1 + 1e-9)).otherwise(1.0))
    unit = {"_u": (F.col("_x") - F.col("_x0")) / F.col("_w"), "_v": (F.col("_y") - F.col("_y0")) / F.col("_w")}
    seeds = rounds.save(seeds.join(square, "_g").withColumns(unit), "seeds")
    columns = ["_g", "_key", "_x", "_y", "_x0", "_y0", "_w"]
    none = F.array().cast(clip.RING)
    cells, crowds = _solved(seeds, rounds, columns)
    tree = None
    if crowds is not None:
        corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(False).alias("ok"))
        box = F.array(corner("_a", "_b"), corner("_c", "_b"), corner("_c", "_d"), corner("_a", "_d"))
        tree = rounds.save(_tree(seeds), "tree")
        first = _first_rings(seeds.join(crowds, ["_g", "_key"], "left_semi"), tree).withColumn("_ring", box)
        cells = cells.unionByName(first.select(*columns, clip.cut_corners(F.col("_x"), F.col("_y"), F.coalesce("others", none), F.col("_ring"), SAME * F.col("_w")).alias("_ring")))
    cells = rounds.save(cells, "cells0")
    opened = F.exists("_ring", lambda p: ~p["ok"])
    bare = F.transform("_ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    done = [cells.where(~opened).select("_g", "_key", "_x", "_y", "_ring")]
    cells = cells.where(opened)
    if cells.isEmpty():
        rounds.drop("seeds")
        return done[0].withColumn("_ring", bare)
    tree = tree or rounds.save(_tree(seeds), "tree")
    frontier = _open_corners(cells)
    n, before = 0, []
    while True:
        asked, levels = _asked(frontier, tree, rounds, f"asked{n}")
        cut = asked.where("b is not null").groupBy("_g", "_key").agg(F.collect_set(F.struct("b.x", "b.y")).alias("others"))
        doubt = asked.groupBy("_g", "_key").agg(F.collect_set(F.struct(F.col("vx").alias("x"), F.col("vy").alias("y"))).alias("doubt"))
        state = cells.join(doubt, ["_g", "_key"], "left").join(cut, ["_g", "_key"], "left")
        known = F.transform("_ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["ok"] | ~F.coalesce(F.array_contains("doubt", F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.lit(False))).alias("ok")))
        state = state.withColumn("_ring", known)
        ring = F.when(F.col("others").isNull(), F.col("_ring")).otherwise(clip.cut_corners(F.col("_x"), F.col("_y"), F.coalesce("others", none), F.col("_ring"), SAME * F.col("_w")))
        state = rounds.save(state.select(*columns, ring.alias("_ring"), F.col("others").isNotNull().alias("cut")), f"state{n}")
        done.append(state.where(~opened).select("_g", "_key", "_x", "_y", "_ring"))
        cells = state.where(opened)
        if cells.isEmpty():
            break
        again = _open_corners(cells.where("cut"))
        deeper = _deeper(asked.join(cells.where("not cut").select("_g", "_key"), ["_g", "_key"], "left_semi"))
        cells, frontier = cells.drop("cut"), again.unionByName(deeper.select(*again.columns))
        rounds.drop(*before)
        before, n = levels, n + 1
    rounds.drop("tree", "seeds")
    return reduce(DataFrame.unionByName, done).withColumn("_ring", bare)


def _closed(ring: Column) -> Column:
    return F.when(F.size(ring) > 2, F.concat(ring, F.slice(ring, 1, 1))).otherwise(F.array().cast(clip.RING))


def voronoi_cells(points: DataFrame, key: str, bounds: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """(key, x, y, ring) for each point inside the bounds, clipped to them. Keys are unique; of points at one place the smallest key stands for all."""
    a, b, c, d = bounds
    places = points.groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.min(key).alias("_key")).where("_x is not null and _y is not null")
    seeds = places.select(F.lit(0).alias("_g"), "_key", "_x", "_y", *(F.lit(float(v)).alias(n) for v, n in ((a, "_a"), (b, "_b"), (c, "_c"), (d, "_d"))))
    cells = cells_in(seeds, Rounds(points.sparkSession, "voronoi"))
    return cells.select(F.col("_key").alias(key), F.col("_x").alias(x), F.col("_y").alias(y), _closed(F.col("_ring")).alias("ring"))


def finite_cells(points: DataFrame, key: str, group: str, margin: float = 0.1, fallback: float = 1000.0, x: str = "x", y: str = "y") -> DataFrame:
    """(group, key, x, y, ring): per group the hull of each cell's finite corners, inside the points' bounding box and ``margin`` of its sides more
    (``fallback`` where a side is 0). Cells of fewer than three finite corners, or without area inside, are left out. Null coordinates and groups are left out;
    of points of a group at one place the smallest key stands for all."""
    places = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    places = places.groupBy(F.col(group).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.min(key).alias("_key"))
    box = places.groupBy("_g").agg(*(f(c).alias(n) for f, c, n in ((F.min, "_x", "_lx"), (F.min, "_y", "_ly"), (F.max, "_x", "_hx"), (F.max, "_y", "_hy"))))
    side = lambda low, high: F.when(F.col(high) > F.col(low), (F.col(high) - F.col(low)) * margin).otherwise(fallback)
    box = box.withColumns({"_mx": side("_lx", "_hx"), "_my": side("_ly", "_hy")})
    far = INFINITE * F.greatest(F.col("_hx") - F.col("_lx"), F.col("_hy") - F.col("_ly"), F.lit(1.0))
    limits = {"_a": F.col("_lx") - far, "_b": F.col("_ly") - far, "_c": F.col("_hx") + far, "_d": F.col("_hy") + far}
    rounds = Rounds(points.sparkSession, "voronoi")
    box = rounds.save(box.withColumns(limits), "boxes")
    cells = cells_in(places.join(box.select("_g", *limits), "_g"), rounds).join(box, "_g")
    edge = 1e-6
    inner = lambda p: (p["x"] > F.col("_a") * (1 - edge) + F.col("_c") * edge) & (p["x"] < F.col("_c") * (1 - edge) + F.col("_a") * edge) & (p["y"] > F.col("_b") * (1 - edge) + F.col("_d") * edge) & (p["y"] < F.col("_d") * (1 - edge) + F.col("_b") * edge)
    hull = cells.withColumn("_ring", _closed(F.filter("_ring", inner))).where(F.size("_ring") > 3)
    envelope = G.box(F.col("_lx") - F.col("_mx"), F.col("_ly") - F.col("_my"), F.col("_hx") + F.col("_mx"), F.col("_hy") + F.col("_my"))
    cut = hull.withColumn("ring", clip.intersection(F.col("_ring"), envelope)).where(F.size("ring") > 0).where(G.area(F.col("ring")) > 0)
    return cut.select(F.col("_g").alias(group), F.col("_key").alias(key), F.col("_x").alias(x), F.col("_y").alias(y), "ring")
