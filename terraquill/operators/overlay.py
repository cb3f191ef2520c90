"""Union and overlay of any polygons: cut into tiles, solved in each tile, added up.

A polygon is an array of rings; what lies in an even number of its rings is outside, so holes are rings like others. All pieces of a tile lie inside it, so
tiles never count anything twice, and no polygon, key or pair of polygons is gathered anywhere. Tiles that hold more than ``MOST`` pieces
are split into four as often as needed, at most ``SPLITS`` times; a piece that fills its tile ends the matter there.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.functions.trapezoids import trapezoids
from terraquill.operators.tables import Rounds

RINGS = f"array<{clip.RING}>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
MOST = 64
SPLITS = 6


def _tile_box(size: Column) -> Column:
    x, y = F.col("tile_x") * size, F.col("tile_y") * size
    return G.box(x, y, x + size, y + size)


def _cut_rings(rings: pa.Array, tile: pa.Array) -> pa.Array:
    out = []
    for polygon, box in zip(rings.to_pylist(), tile.to_pylist()):
        frame = clip._points(box)
        parts = (clip.clip_ring(clip._points(r), frame) for r in polygon)
        out.append([clip._ring(r) for r in parts if len(r) > 2])
    return pa.array(out, _RINGS)


def _in_tile(pieces: DataFrame, size: Column, columns: list[str]) -> DataFrame:
    """The pieces inside their tile, without those of no area; ``full`` if a piece is a single ring that fills the tile. Boxes that
    hold or miss the tile are told apart before any corner is looked at."""
    box = _tile_box(size)
    cut = pieces.withColumn("_rings", F.arrow_udf(_cut_rings, RINGS)(F.col("_rings"), box)).where(F.size("_rings") > 0)
    areas = F.transform("_rings", G.area)
    cut = cut.withColumn("_area", F.array_max(areas)).where("_area > 0")
    return cut.select(*columns, "_size", "tile_x", "tile_y", "_rings", ((F.size("_rings") == 1) & (F.col("_area") >= size * size * (1 - 1e-12))).alias("full"))


def tiled(polygons: DataFrame, rings: str, size: float, columns: list[str]) -> DataFrame:
    """(columns, _size, tile_x, tile_y, _rings, full): the parts of each polygon in the tiles that its box touches."""
    corners = F.flatten(rings)
    box = polygons.where(F.size(corners) > 2).withColumn("_b", F.struct(*G.bounds(corners)))

    def along(low: str, high: str) -> Column:
        first = F.floor(F.col(low) / size)
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(high) / size) - 1)))

    placed = box.withColumn("tile_x", along("_b.x_min", "_b.x_max")).withColumn("tile_y", along("_b.y_min", "_b.y_max"))
    placed = placed.select(*columns, F.lit(float(size)).alias("_size"), "tile_x", "tile_y", F.col(rings).cast(RINGS).alias("_rings"))
    return _in_tile(placed, F.col("_size"), columns)


def _solve(table: pa.Table, columns: list[str]) -> pa.Table:
    found = trapezoids([[clip._points(r) for r in rings] for rings in table.column("_rings").to_pylist()])
    head = table.select(columns).take(pa.array([0] * len(found), pa.int64()))
    return head.append_column("ring", pa.array([clip._ring(r) for r in found], _RINGS.value_type))


def union_pieces(polygons: DataFrame, key: list[str], rings: str, size: float) -> DataFrame:
    """(key, ring): disjoint convex rings that cover, for each key, what lies in any of its polygons."""
    rounds = Rounds(polygons.sparkSession, "union")
    schema = ", ".join(f"`{c}` {polygons.schema[c].dataType.simpleString()}" for c in key)
    # One name for each key, so that null keys meet too.
    columns, place = [*key, "_k"], ["_k", "_size", "tile_x", "tile_y"]
    # Copies go before any corner is cut, so that they cost a partial aggregate only.
    once = polygons.select(*key, F.to_json(F.struct(*key)).alias("_k"), F.col(rings).cast(RINGS).alias(rings)).dropDuplicates(["_k", rings])
    todo = tiled(once, rings, size, columns).dropDuplicates([*place, "_rings"])
    solved: list[DataFrame] = []
    for k in range(SPLITS + 1):
        todo = rounds.save(todo, f"tiles{k}")
        counts = todo.groupBy(*place).agg(F.count("*").alias("_n"), F.bool_or("full").alias("_whole"), *(F.min(c).alias(c) for c in key))
        whole = counts.where("_whole").select(*key, _tile_box(F.col("_size")).alias("ring"))
        many = (F.col("_n") > MOST) & F.lit(k < SPLITS)
        few = todo.join(counts.where(~F.col("_whole") & ~many).select(*place), place)
        solved += [whole, few.groupBy(*place).applyInArrow(lambda table: _solve(table, key), f"{schema}, ring {clip.RING}")]
        if k == SPLITS:
            break
        crowded = counts.where(~F.col("_whole") & many).select(*place)
        if crowded.isEmpty():
            break
        quarters = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
        split = todo.join(crowded, place).select(*columns, "_rings", (F.col("_size") / 2).alias("_size"), "tile_x", "tile_y", F.inline(quarters))
        split = split.withColumns({"tile_x": 2 * F.col("tile_x") + F.col("i"), "tile_y": 2 * F.col("tile_y") + F.col("j")}).drop("i", "j")
        todo = _in_tile(split, F.col("_size"), columns).dropDuplicates([*place, "_rings"])
    return reduce(DataFrame.unionByName, solved)


def dissolve(polygons: DataFrame, key: list[str], ring: str, size: float, *first: str) -> DataFrame:
    """One row for each key: ``rings`` (disjoint convex pieces of the union of its polygons), ``area`` of the union, ``n_parts`` (polygons), and the smallest value of
    the columns ``first``. ``ring`` is a ring or an array of rings. Null and empty polygons have no area; a key with no others has no pieces and area 0."""
    rings = F.array(ring) if polygons.schema[ring].dataType.simpleString() == clip.RING else F.col(ring)
    named = polygons.withColumn("_all", rings)
    pieces = union_pieces(named, key, "_all", size).withColumnsRenamed({c: f"_{c}" for c in key})
    union = pieces.groupBy(*(f"_{c}" for c in key)).agg(F.collect_list("ring").alias("rings"), F.sum(G.area(F.col("ring"))).alias("area"))
    groups = polygons.groupBy(*key).agg(F.count(ring).alias("n_parts"), *(F.min(c).alias(c) for c in first))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    out = groups.join(union, same, "left").drop(*(f"_{c}" for c in key))
    return out.withColumns({"rings": F.coalesce("rings", F.array().cast(RINGS)), "area": F.coalesce("area", F.lit(0.0))})


def _decomposed(rings: pa.Array) -> pa.Array:
    return pa.array([[clip._ring(t) for t in trapezoids([[clip._points(r) for r in polygon]])] for polygon in rings.to_pylist()], _RINGS)


def convex_pieces(polygons: DataFrame, rings: str, size: float, columns: list[str]) -> DataFrame:
    """(columns, tile_x, tile_y, piece, full): convex pieces of each polygon, tile by tile. ``full``: the piece fills its tile."""
    parts = tiled(polygons, rings, size, columns)
    cut = parts.where("not full").withColumn("piece", F.explode(F.arrow_udf(_decomposed, RINGS)("_rings")))
    whole = parts.where("full").withColumn("piece", _tile_box(F.col("_size")))
    return whole.unionByName(cut).select(*columns, "tile_x", "tile_y", "piece", "full")


def overlay(a: DataFrame, b: DataFrame, a_rings: str, b_rings: str, size: float, shuffled: bool = False) -> DataFrame:
    """Pieces of polygons inside polygons, neither of which need be convex: both sides' other columns (with different names), ``piece`` (convex) and
    ``piece_area`` (> 0). Pieces of one pair are disjoint, so their areas add up. Where one side fills the tile, the other side's piece is the result as it is.
    ``shuffled``: neither side is broadcast, however small its files are."""
    keep_a, keep_b = ([c for c in d.columns if c != r] for d, r in ((a, a_rings), (b, b_rings)))
    p = convex_pieces(a, a_rings, size, keep_a).withColumnsRenamed({"piece": "_p", "full": "_fp"})
    q = convex_pieces(b, b_rings, size, keep_b).withColumnsRenamed({"piece": "_q", "full": "_fq"})
    met = p.join(q.hint("merge") if shuffled else q, ["tile_x", "tile_y"])
    u, v = G.bounds(F.col("_p")), G.bounds(F.col("_q"))
    met = met.where((u[0] < v[2]) & (v[0] < u[2]) & (u[1] < v[3]) & (v[1] < u[3]))
    plain = met.where("_fp or _fq").withColumn("piece", F.when(F.col("_fq"), F.col("_p")).otherwise(F.col("_q")))
    cut = met.where("not (_fp or _fq)").withColumn("piece", clip.intersection(F.col("_p"), F.col("_q"))).where(F.size("piece") > 0)
    out = plain.unionByName(cut).select(*keep_a, *keep_b, "piece", G.area(F.col("piece")).alias("piece_area"))
    return out.where("piece_area > 0")
