"""Target areas of settlements, state by state: tessellation, own ward, extents, fall-back circles, and their grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.operators import overlay as O
from terraquill.operators import spatial
from terraquill.operators.relational import drop_unless_whole_group
from terraquill.operators.tables import Rounds
from terraquill.operators.voronoi import finite_cells

#: States of fewer distinct places get circles instead of a tessellation.
LEAST_PLACES = 4
#: Pieces of cells that may be broadcast to the extents' tiles, and distinct places of buildings to the grid.
PIECES, PLACES = 50_000, 200_000
ADMIN = ("state", "lga", "ward")


def located(settlements: DataFrame, wards: DataFrame, key: str, ring: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, at_state, at_lga, at_ward): the ward that a settlement's point lies in; the first by name if there are several."""
    held = wards.select(*(F.col(c).alias(f"at_{c}") for c in ADMIN), F.col(ring).alias("_ring"))
    inside = spatial.points_in_polygons(settlements.select(key, x, y).hint("merge"), held, "_ring", x, y, size)
    first = F.min(F.struct(*(f"at_{c}" for c in ADMIN))).alias("_at")
    return inside.groupBy(key).agg(first).select(key, "_at.*")


def target_areas(
    settlements: DataFrame, wards: DataFrame, extents: DataFrame, key: str, size: float = 1000.0,
    ward_ring: str = "ring", extent_rings: str = "rings", kind: str = "type", x: str = "x", y: str = "y",
) -> DataFrame:
    """One row for each settlement and kind of extent: key, state, origin, type, ring pieces (``rings``, disjoint and convex) and ``area``.

    1. Per state, the cell of each distinct place (``finite_cells``), or a circle of ``FALLBACK_BUFFER`` where the state has fewer than ``LEAST_PLACES``.
    2. The part of it in the ward in which the settlement's point lies.
    3. Of this, the parts in extents (any polygons, with holes or without) that hold the point: origin ``cell``, with the extent's type.
    4. A settlement without such a part has a circle around its point: origin ``circle``, no type.

    Settlements of a state at one place share the area of the smallest key. Those without coordinates or state have origin ``none`` and no area.
    ``settlements`` has key, state, x, y; ``wards`` state, lga, ward and a ring; ``extents`` rings and a type. Keys are unique.
    """
    rounds = Rounds(settlements.sparkSession, "target_areas")
    s = settlements.select(F.col(key).alias("_k"), F.col("state").alias("_s"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    placed = s.where("_s is not null and _x is not null and _y is not null")
    heads = rounds.save(placed.groupBy("_s", "_x", "_y").agg(F.min("_k").alias("_head")), "heads")
    states = heads.groupBy("_s").agg(F.count("*").alias("_n"))
    own = heads.join(states, "_s")
    circle = G.circle(F.col("_x"), F.col("_y"), S.FALLBACK_BUFFER)
    many = own.where(F.col("_n") >= LEAST_PLACES)
    cells = finite_cells(many, "_head", "_s", x="_x", y="_y").select("_s", "_head", "_x", "_y", F.col("ring").alias("_ring"))
    cells = cells.unionByName(own.where(F.col("_n") < LEAST_PLACES).select("_s", "_head", "_x", "_y", circle.alias("_ring")))
    at = located(heads, wards, "_head", ward_ring, size, "_x", "_y")
    cells = cells.join(at, "_head").select("_head", "_x", "_y", *(f"at_{c}" for c in ADMIN), F.array("_ring").alias("_rings"))
    cells = rounds.save(cells, "cells")
    inner = wards.select(*(F.col(c).alias(f"in_{c}") for c in ADMIN), F.array(ward_ring).alias("_ward"))
    same = [F.col(f"at_{c}").eqNullSafe(F.col(f"in_{c}")) for c in ADMIN]
    clipped = O.overlay(cells, inner, "_rings", "_ward", size).where(same[0] & same[1] & same[2])
    clipped = rounds.save(clipped.select("_head", "_x", "_y", F.array("piece").alias("_rings")), "clipped")
    e = extents.select(F.monotonically_increasing_id().alias("_e"), F.col(kind).alias("_type"), F.col(extent_rings).alias("_extent"))
    e = rounds.save(e, "extents")
    parts = rounds.save(O.overlay(clipped, e, "_rings", "_extent", size, shuffled=clipped.limit(PIECES + 1).count() > PIECES), "parts")
    # A part is what a cell has of one extent; the pieces that it was solved in stay together.
    hit = parts.groupBy("_head", "_e").agg(F.max(G.contains(F.col("piece"), F.col("_x"), F.col("_y"))).alias("_hit")).where("_hit").drop("_hit")
    kept = parts.join(hit.hint("merge"), ["_head", "_e"]).groupBy("_head", "_type").agg(F.collect_list("piece").alias("rings"), F.sum("piece_area").alias("area"))
    kept = rounds.save(kept.select("_head", F.lit("cell").alias("origin"), F.col("_type").alias("type"), "rings", "area"), "kept")
    # Written tables take far less than their rows do, and circles are made of two numbers each: by the sizes of files, all of these would be broadcast.
    found = placed.join(heads.hint("merge"), ["_s", "_x", "_y"]).select("_k", "_s", "_x", "_y", "_head").join(kept.hint("merge"), "_head", "left")
    bare = F.col("origin").isNull()
    rings, area = F.when(bare, F.array(circle)).otherwise(F.col("rings")), F.when(bare, G.area(circle)).otherwise(F.col("area"))
    named = found.select("_k", "_s", F.coalesce("origin", F.lit("circle")).alias("origin"), "type", rings.alias("rings"), area.alias("area"))
    none = s.where("_s is null or _x is null or _y is null").select("_k", "_s", F.lit("none").alias("origin"))
    out = named.unionByName(none, allowMissingColumns=True)
    return out.select(F.col("_k").alias(key), F.col("_s").alias("state"), "origin", "type", "rings", "area")


def grid_size(kind: Column) -> Column:
    return F.when(kind.eqNullSafe("Built-up Area"), S.GRID_SIZE_BUILT_UP).otherwise(S.GRID_SIZE_OTHER)


def gridded_target_areas(areas: DataFrame, buildings: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, state, type, cell_x, cell_y, area, buildings): the cells of the target areas, 50 m wide where built up, else 100 m, counted from the lower left corner of all areas of
    the state and size. Cells of more than ``AREA_LIMIT`` square metres with their buildings; those with at most ``BUILDING_LIMIT`` go, but for settlements that
    would lose all. A cell's area is what the settlement has of it.
    """
    rounds = Rounds(areas.sparkSession, "gridded_areas")
    pieces = areas.select(key, "state", "type", grid_size(F.col("type")).alias("_size"), F.explode("rings").alias("_piece")).withColumn("_b", F.struct(*G.bounds(F.col("_piece"))))
    pieces = rounds.save(pieces, "pieces")
    corner = rounds.save(pieces.groupBy("state", "_size").agg(F.min("_b.x_min").alias("_x0"), F.min("_b.y_min").alias("_y0")), "corners")
    p = pieces.join(corner, ["state", "_size"])

    def along(v: str) -> Column:
        at = lambda end: (F.col(f"_b.{v}_{end}") - F.col(f"_{v}0")) / F.col("_size")
        first = F.floor(at("min"))
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(at("max")) - 1)))

    cells = p.withColumn("cell_x", along("x")).withColumn("cell_y", along("y"))
    left, low = F.col("_x0") + F.col("cell_x") * F.col("_size"), F.col("_y0") + F.col("cell_y") * F.col("_size")
    box = G.box(left, low, left + F.col("_size"), low + F.col("_size"))
    inside = (F.col("_b.x_min") >= left) & (F.col("_b.x_max") <= left + F.col("_size")) & (F.col("_b.y_min") >= low) & (F.col("_b.y_max") <= low + F.col("_size"))
    columns = [key, "state", "type", "_size", "cell_x", "cell_y"]
    whole = cells.where(inside).select(*columns, F.col("_piece").alias("_ring"))
    cut = cells.where(~inside).select(*columns, clip.intersection(F.col("_piece"), box).alias("_ring")).where(F.size("_ring") > 0)
    cells = rounds.save(whole.unionByName(cut).withColumn("_a", G.area(F.col("_ring"))).where("_a > 0").withColumn("_id", F.monotonically_increasing_id()), "cells")
    at = rounds.save(spatial.places(buildings, x, y), "places")
    at = F.broadcast(at) if at.limit(PLACES + 1).count() <= PLACES else at.hint("merge")
    counted = spatial.count_places(cells, at, "_id", "_ring", x, y, S.GRID_SIZE_BUILT_UP, "_n")
    summed = counted.groupBy(*columns).agg(F.sum("_a").alias("area"), F.sum("_n").alias("buildings")).where(F.col("area") > S.AREA_LIMIT).drop("_size")
    return drop_unless_whole_group(summed, [key], F.col("buildings") <= S.BUILDING_LIMIT)
