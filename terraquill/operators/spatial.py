"""Spatial joins as equality joins on cell keys, with the exact predicate after.

Every operator turns its theta condition into keys of a square grid: a polygon has the cells of its bounding box, a
point has one cell, a radius search looks at the 3 x 3 cells around a point. No plan holds a nested-loop join, and what is only asked
for as existence or count is reduced before wide rows are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.functions import geometry as G

#: Cells that one polygon may cover before it is indexed on a grid that is coarser by ``COARSER``.
MAX_CELLS = 4096
COARSER = 64
#: Points in a cell from which on it is split into ``SPLIT`` x ``SPLIT`` cells, ``DEPTH`` times at most; of all points in more cells than ``CROWDS`` allows, only
#: the fullest cells are split, so that their table stays small.
CROWD, SPLIT, DEPTH, CROWDS = 20_000, 8, 3, 100_000


def polygon_cells(polygons: DataFrame, ring: str, size: float) -> DataFrame:
    """One row for each cell of a polygon's bounding box: cell_level, cell_x, cell_y. A polygon that covers more than
    ``MAX_CELLS`` is indexed at level 1, on cells ``COARSER`` times as wide. Upper edges are outside, so a box that ends on a cell's
    edge doesn't reach the next cell."""
    box = polygons.withColumn("_b", F.struct(*G.bounds(F.col(ring))))
    spans = lambda s: (
        (G.cell(F.col("_b.x_max"), s) - G.cell(F.col("_b.x_min"), s) + 1) * (G.cell(F.col("_b.y_max"), s) - G.cell(F.col("_b.y_min"), s) + 1)
    )
    level = F.when(spans(size) <= MAX_CELLS, 0).otherwise(1)
    width = F.when(F.col("cell_level") == 0, F.lit(float(size))).otherwise(F.lit(float(size) * COARSER))

    def along(low: str, high: str) -> Column:
        first = F.floor(F.col(low) / F.col("_w"))
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(high) / F.col("_w")) - 1)))

    return (
        box.withColumn("cell_level", level)
        .withColumn("_w", width)
        .withColumn("cell_x", along("_b.x_min", "_b.x_max"))
        .withColumn("cell_y", along("_b.y_min", "_b.y_max"))
        .drop("_b", "_w")
    )


def crowded_cells(points: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(depth, cell_x, cell_y): cells of more than ``CROWD`` points, at the depths above the last; one aggregate with partial sums."""
    finest = width / SPLIT ** (DEPTH - 1)
    fine = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(G.cell(F.col(x), finest).alias("_fx"), G.cell(F.col(y), finest).alias("_fy")).agg(F.count("*").alias("_n"))
    up = F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(SPLIT ** (DEPTH - 1 - d)).cast("long").alias("_by")) for d in range(DEPTH)))
    cells = fine.select("_fx", "_fy", "_n", F.inline(up)).groupBy(
        "depth", F.floor(F.col("_fx") / F.col("_by")).alias("cell_x"), F.floor(F.col("_fy") / F.col("_by")).alias("cell_y")
    ).agg(F.sum("_n").alias("_n"))
    most = F.greatest(F.lit(CROWD), F.col("_all") / CROWDS)
    total = fine.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    limit = total.select(most.alias("m")).first()["m"]
    return cells.where(F.col("_n") > limit).select("depth", "cell_x", "cell_y")


def _split(side: DataFrame, crowds: DataFrame, below) -> DataFrame:
    """The side with ``depth`` and cells no coarser than its crowds ask for. ``below`` puts rows of a crowded cell, at a depth, into the cells under it."""
    done, todo = [], side.withColumn("depth", F.lit(0))
    for d in range(DEPTH):
        named = F.broadcast(crowds.where(F.col("depth") == d).drop("depth"))  # at most CROWDS a depth
        done.append(todo.join(named, ["cell_x", "cell_y"], "left_anti"))
        todo = below(todo.join(named, ["cell_x", "cell_y"], "left_semi"), d + 1).withColumn("depth", F.lit(d + 1))
    return reduce(DataFrame.unionByName, [*done, todo])


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str, x: str = "x", y: str = "y", size: float = 50.0, adaptive: bool = False) -> DataFrame:
    """Inner join of points and the polygons that contain them; all columns of both. Each level of cells is a join of its own, which
    adaptive execution leaves out where no polygon is of that level. The bounding box, taken once for each polygon, is tested before the edges, and
    a ring that is its own box needs no look at them. ``adaptive``: crowded cells are split, for which the points are counted first."""
    b = G.bounds(F.col(ring))
    boxed = polygons.withColumn("_pb", F.struct(*b)).withColumn("_square", (F.size(ring) <= 5) & (G.area(F.col(ring)) == (F.col("_pb.x_max") - F.col("_pb.x_min")) * (F.col("_pb.y_max") - F.col("_pb.y_min"))))
    cells = polygon_cells(boxed, ring, size)
    found = []
    for level, width in enumerate((size, size * COARSER)):
        placed = points.withColumn("cell_x", G.cell(F.col(x), width)).withColumn("cell_y", G.cell(F.col(y), width))
        mine, keys = cells.where(F.col("cell_level") == level), ["cell_x", "cell_y"]
        crowds = crowded_cells(points, x, y, width) if adaptive else None
        if crowds is not None and not crowds.isEmpty():

            def points_below(rows: DataFrame, depth: int, width: float = width) -> DataFrame:
                side = width / SPLIT**depth
                return rows.withColumns({"cell_x": G.cell(F.col(x), side), "cell_y": G.cell(F.col(y), side)})

            def polygons_below(rows: DataFrame, depth: int, width: float = width) -> DataFrame:
                side = width / SPLIT**depth

                def along(cell: str, low: str, high: str) -> Column:
                    first = F.greatest(F.col(cell) * SPLIT, F.floor(F.col(low) / side))
                    return F.explode(F.sequence(first, F.greatest(first, F.least(F.col(cell) * SPLIT + SPLIT - 1, F.ceil(F.col(high) / side) - 1))))

                return rows.withColumn("cell_x", along("cell_x", "_pb.x_min", "_pb.x_max")).withColumn("cell_y", along("cell_y", "_pb.y_min", "_pb.y_max"))

            placed, mine, keys = _split(placed, crowds, points_below), _split(mine, crowds, polygons_below), ["depth", "cell_x", "cell_y"]
        found.append(placed.join(mine, keys).drop("depth") if "depth" in keys else placed.join(mine, keys))
    pairs = found[0].unionByName(found[1])
    low, high = (F.col(x) >= F.col("_pb.x_min")) & (F.col(y) >= F.col("_pb.y_min")), (F.col(x) <= F.col("_pb.x_max")) & (F.col(y) <= F.col("_pb.y_max"))
    inside = F.when(F.col("_square"), (F.col(x) < F.col("_pb.x_max")) & (F.col(y) < F.col("_pb.y_max"))).otherwise(G.contains(F.col(ring), F.col(x), F.col(y)))
    return pairs.where(low & high).where(inside).drop("cell_level", "cell_x", "cell_y", "_pb", "_square")


def places(points: DataFrame, x: str, y: str, n: str = "_n") -> DataFrame:
    """Distinct coordinates with their number of points; each task counts its own first, so a common place is no hot key."""
    return points.groupBy(x, y).agg(F.count("*").alias(n))


def count_points(polygons: DataFrame, points: DataFrame, key: str, ring: str, x: str = "x", y: str = "y", size: float = 50.0, name: str = "n") -> DataFrame:
    """The polygons with the number of points inside, 0 where there is none."""
    return count_places(polygons, places(points, x, y), key, ring, x, y, size, name)


def count_places(polygons: DataFrame, at: DataFrame, key: str, ring: str, x: str = "x", y: str = "y", size: float = 50.0, name: str = "n") -> DataFrame:
    """``count_points`` of points that are ``places`` already."""
    inside = points_in_polygons(at, polygons.select(key, ring), ring, x, y, size)
    counts = inside.groupBy(key).agg(F.sum("_n").alias(name))
    return polygons.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def polygons_hit(polygons: DataFrame, points: DataFrame, key: str, ring: str, x: str = "x", y: str = "y", size: float = 50.0, name: str = "hit") -> DataFrame:
    """The polygons and whether any point lies inside; only distinct places meet polygons, and distinct keys are joined back."""
    inside = points_in_polygons(places(points, x, y).drop("_n"), polygons.select(key, ring), ring, x, y, size)
    hits = inside.select(key).distinct().withColumn(name, F.lit(True))
    return polygons.join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def outside_all(points: DataFrame, polygons: DataFrame, key: str, ring: str, x: str = "x", y: str = "y", size: float = 50.0) -> DataFrame:
    """Points that lie in no polygon."""
    inside = points_in_polygons(points.select(key, x, y), polygons.select(ring), ring, x, y, size)
    return points.join(inside.select(key).distinct(), key, "left_anti")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(left_key, right_key, distance) for all pairs within the radius. Cells are as wide as the radius; the left side, better the
    smaller one, looks at nine of them."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.select(F.col(left_key).alias("_a"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), F.inline(near)).select(
        "_a", "_ax", "_ay", (G.cell(F.col("_ax"), radius) + F.col("i")).alias("_cx"), (G.cell(F.col("_ay"), radius) + F.col("j")).alias("_cy")
    )
    b = right.select(
        F.col(right_key).alias("_b"), F.col(x).alias("_bx"), F.col(y).alias("_by"), G.cell(F.col(x), radius).alias("_cx"), G.cell(F.col(y), radius).alias("_cy")
    )
    distance = G.planar(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))
    return a.join(b, ["_cx", "_cy"]).select("_a", "_b", distance.alias("distance")).where(F.col("distance") <= radius)


def within(left: DataFrame, right: DataFrame, radius: float, key: str, right_key: str, x: str = "x", y: str = "y", name: str = "within") -> DataFrame:
    """Left rows and whether anything on the right lies within the radius; of the right side, distinct places take part."""
    hits = near_pairs(left, right.groupBy(x, y).agg(F.min(right_key).alias(right_key)), radius, key, right_key, x, y).select(F.col("_a").alias(key)).distinct().withColumn(name, F.lit(True))
    return left.join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str, right_key: str, x: str = "x", y: str = "y", farthest: bool = False) -> DataFrame:
    """Left rows with the nearest (or farthest) right key within the radius, ties to the smallest key, and its distance; nulls if none."""
    # Of the points at one place the smallest key wins any tie.
    pairs = near_pairs(left, right.groupBy(x, y).agg(F.min(right_key).alias(right_key)), radius, key, right_key, x, y)
    by = F.struct((-F.col("distance") if farthest else F.col("distance")).alias("d"), F.col("_b").alias("k"))
    best = pairs.groupBy("_a").agg(F.min(by).alias("_best"))
    d = F.col("_best.d")
    best = best.select(F.col("_a").alias(key), F.col("_best.k").alias(f"near_{right_key}"), (-d if farthest else d).alias("distance"))
    return left.join(best, key, "left")


def stacked(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, _first, _second, _n): each distinct place with its two smallest keys (the second null for a lone point) and its number of points. Keys are unique, so
    that the anti join deals a crowd over all tasks."""
    heads = points.groupBy(x, y).agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
    rest = points.join(heads.where("_n > 1").select(F.col("_first").alias(key)), key, "left_anti")
    seconds = rest.groupBy(F.col(x).alias("_sx"), F.col(y).alias("_sy")).agg(F.min(key).alias("_second"))
    crowds = heads.where("_n > 1").join(seconds, (F.col(x) == F.col("_sx")) & (F.col(y) == F.col("_sy"))).drop("_sx", "_sy")
    return crowds.unionByName(heads.where("_n = 1"), allowMissingColumns=True).select(x, y, "_first", "_second", "_n")


def neighbours(points: DataFrame, radius: float, key: str, x: str = "x", y: str = "y", farthest: bool = False) -> DataFrame:
    """Each point with its number of other points within the radius, and the nearest (or farthest) of them, ties to the smallest key. Pairs are made
    of distinct places with counts, so a crowd at one place makes none; what a place has found is joined back to its points."""
    at = stacked(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key, x, y)
    pairs = near_pairs(at, at, radius, "_first", "_first", x, y).where("_a != _b")
    pairs = pairs.join(at.select(F.col("_first").alias("_b"), F.col("_n").alias("_bn")), "_b")
    by = F.struct((-F.col("distance") if farthest else F.col("distance")).alias("d"), F.col("_b").alias("k"))
    best = pairs.groupBy("_a").agg(F.sum("_bn").alias("_others"), F.min(by).alias("_best"))
    found = at.join(best, F.col("_first") == F.col("_a"), "left").select(F.col(x).alias("_px"), F.col(y).alias("_py"), "_first", "_second", "_n", "_others", "_best")
    own = F.when(F.col("_n") > 1, F.struct(F.lit(0.0).alias("d"), F.when(F.col(key) == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("k")))
    joined = points.join(found, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left").withColumn("_best", F.least(own, "_best"))
    d = F.col("_best.d")
    near = F.coalesce(F.col("_n") - 1, F.lit(0)) + F.coalesce("_others", F.lit(0))
    return joined.select(*points.columns, near.alias("n_near"), F.col("_best.k").alias("near_key"), (-d if farthest else d).alias("distance"))


def grid(polygons: DataFrame, ring: str, size: Column) -> DataFrame:
    """Square cells over each polygon's bounding box: grid_x, grid_y (numbers from its corner) and grid_ring."""
    b = polygons.withColumn("_b", F.struct(*G.bounds(F.col(ring)))).withColumn("_s", size)
    steps = lambda a, c: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(c) - F.col(a)) / F.col("_s")) - 1, F.lit(0))))
    cells = b.withColumn("grid_x", steps("_b.x_min", "_b.x_max")).withColumn("grid_y", steps("_b.y_min", "_b.y_max"))
    x0, y0 = F.col("_b.x_min") + F.col("grid_x") * F.col("_s"), F.col("_b.y_min") + F.col("grid_y") * F.col("_s")
    return cells.withColumn("grid_ring", G.box(x0, y0, x0 + F.col("_s"), y0 + F.col("_s"))).drop("_b", "_s")
