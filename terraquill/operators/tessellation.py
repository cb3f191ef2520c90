"""Target-area geometry: building counts of gridded extents, point dispersion, cells cut to extents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import clip
from terraquill.functions import geometry as G
from terraquill.functions.nearest import nearest_before
from terraquill.operators import spatial
from terraquill.operators.graph import cut_lineage
from terraquill.operators.overlay import overlay
from terraquill.operators.relational import drop_unless_whole_group
from terraquill.operators.tables import Rounds
from terraquill.operators.voronoi import voronoi_cells

#: Width of the tiles in which points are dispersed, and the points in a tile from which on it isn't gathered.
TILE, CROWDED = 500.0, 200_000


def gridded_area(extents: DataFrame, key: str, ring: str, kind: str, buildings: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Cells of each extent (50 m where built up, else 100 m) of more than 30 square metres with their buildings; cells
    with two or fewer go, but for extents that would lose all."""
    size = F.when(F.col(kind) == "Built-up Area", S.GRID_SIZE_BUILT_UP).otherwise(S.GRID_SIZE_OTHER)
    cells = spatial.grid(extents, ring, size)
    cells = cells.withColumn("piece", clip.intersection(F.col(ring), F.col("grid_ring")))
    cells = cells.where(F.size("piece") > 0).withColumn("area", G.area(F.col("piece"))).where(F.col("area") > S.AREA_LIMIT)
    cells = cells.withColumn("cell", F.concat_ws("_", key, "grid_x", "grid_y"))
    counted = spatial.count_points(cells, buildings, "cell", "piece", x, y, S.GRID_SIZE_BUILT_UP, "buildings")
    return drop_unless_whole_group(counted, [key], F.col("buildings") <= S.BUILDING_LIMIT)


def disperse(points: DataFrame, key: str, x: str = "x", y: str = "y", rounds: int = S.SHIFT_ROUNDS) -> DataFrame:
    """Points moved until all are ``MIN_DISTANCE`` apart or the rounds are used up; adds ``x_new`` and ``y_new``.

    In each round every point that stands too near to one with a smaller key moves ``TARGET_DISTANCE`` away from the nearest of these. All
    move at once, from one written table to the next. A round is one shuffle: each tile of ``TILE`` metres looks for the nearest smaller keys among its points and
    those around it, in work that grows with the points and not with the pairs. Tiles of more than ``CROWDED`` points aren't gathered: they meet as distinct places, in grid cells.
    The direction from a coincident point comes from the key, so reruns agree. Points without coordinates stay.
    """
    rounds_ = Rounds(points.sparkSession, "disperse")
    angle = F.pmod(F.xxhash64(F.lit(7), key), F.lit(3600)) * math.pi / 1800
    unit = [F.cos(angle).alias("_ux"), F.sin(angle).alias("_uy")]
    start = points.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("x_new"), F.col(y).cast("double").alias("y_new"), *unit)
    place = rounds_.save(start.where("x_new is not null and y_new is not null"), "place")
    last = "place"
    for n in range(rounds):
        moved = rounds_.save(_moved(place), f"place{n}")
        if moved.where("_moved").isEmpty():
            break
        place = moved.drop("_moved")
        rounds_.drop(last)
        last = f"place{n}"
    return points.join(place.select(F.col("_k").alias(key), "x_new", "y_new"), key, "left")


def _moved(place: DataFrame) -> DataFrame:
    """The places after one round, and whether they have moved."""
    tile = {"_tx": G.cell(F.col("x_new"), TILE), "_ty": G.cell(F.col("y_new"), TILE)}
    crowds = place.withColumns(tile).groupBy("_tx", "_ty").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("_tx", "_ty")
    crowds = cut_lineage(crowds)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in place.schema) + ", _moved boolean"
    if crowds.isEmpty():
        return _dealt(place).groupBy("_tx", "_ty").applyInArrow(_tile_moved, schema)
    dealt = _dealt(place)
    plain = dealt.join(crowds, ["_tx", "_ty"], "left_anti").groupBy("_tx", "_ty").applyInArrow(_tile_moved, schema)
    mine = dealt.join(crowds, ["_tx", "_ty"], "left_semi")
    return plain.unionByName(_crowd_moved(mine.where("_own").drop("_own", "_tx", "_ty"), mine.drop("_own", "_tx", "_ty").dropDuplicates(["_k"])))


def _dealt(place: DataFrame) -> DataFrame:
    """The points of each tile (_tx, _ty; _own) and those within ``MIN_DISTANCE`` of it."""

    def tiles(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - S.MIN_DISTANCE) / TILE), F.floor((F.col(c) + S.MIN_DISTANCE) / TILE)))

    own = (G.cell(F.col("x_new"), TILE) == F.col("_tx")) & (G.cell(F.col("y_new"), TILE) == F.col("_ty"))
    return place.withColumn("_tx", tiles("x_new")).withColumn("_ty", tiles("y_new")).withColumn("_own", own)


def _tile_moved(table: pa.Table) -> pa.Table:
    own = table.column("_own").to_numpy(zero_copy_only=False)
    names = [c for c in table.column_names if c not in ("_tx", "_ty", "_own")]
    x, y, ux, uy = (table.column(c).to_numpy() for c in ("x_new", "y_new", "_ux", "_uy"))
    rank = np.empty(len(x), np.int64)
    rank[pc.sort_indices(table.column("_k")).to_numpy()] = np.arange(len(x))
    d, b = nearest_before(x, y, rank, np.flatnonzero(own), S.MIN_DISTANCE)
    moves, at = b[own] >= 0, np.flatnonzero(own)
    k, o = at[moves], b[own][moves]
    far = np.where(d[k] > 0, d[k], 1.0)
    new_x, new_y = x.copy(), y.copy()
    new_x[k] = x[o] + S.TARGET_DISTANCE * np.where(d[k] > 0, (x[k] - x[o]) / far, ux[k])
    new_y[k] = y[o] + S.TARGET_DISTANCE * np.where(d[k] > 0, (y[k] - y[o]) / far, uy[k])
    columns = {c: table.column(c).take(pa.array(at)) for c in names} | {"x_new": pa.array(new_x[at]), "y_new": pa.array(new_y[at]), "_moved": pa.array(moves)}
    return pa.table(columns)


def _crowd_moved(own: DataFrame, around: DataFrame) -> DataFrame:
    """``_moved`` for the points of tiles that hold too many to be gathered: of the points at one place only the smallest key meets other places."""
    heads = around.groupBy("x_new", "y_new").agg(F.min("_k").alias("_head"))
    pairs = spatial.near_pairs(heads, heads, S.MIN_DISTANCE, "_head", "_head", "x_new", "y_new")
    pairs = pairs.where((F.col("_b") < F.col("_a")) & (F.col("distance") < S.MIN_DISTANCE))
    first = pairs.groupBy("_a").agg(F.min(F.struct("distance", "_b")).alias("_n")).select("_a", "_n.distance", "_n._b")
    on = [F.col("x_new") == F.col("_hx"), F.col("y_new") == F.col("_hy")]
    crowd = own.join(heads.withColumnsRenamed({"x_new": "_hx", "y_new": "_hy"}), on).where(F.col("_k") != F.col("_head"))
    near = first.unionByName(crowd.select(F.col("_k").alias("_a"), F.lit(0.0).alias("distance"), F.col("_head").alias("_b")))
    fixed = heads.select(F.col("_head").alias("_b"), F.col("x_new").alias("_bx"), F.col("y_new").alias("_by"))
    near = near.join(fixed, "_b").select(F.col("_a").alias("_k"), "distance", "_bx", "_by")
    d = F.col("distance")
    step = {
        "x_new": F.col("_bx") + S.TARGET_DISTANCE * F.when(d > 0, (F.col("x_new") - F.col("_bx")) / d).otherwise(F.col("_ux")),
        "y_new": F.col("_by") + S.TARGET_DISTANCE * F.when(d > 0, (F.col("y_new") - F.col("_by")) / d).otherwise(F.col("_uy")),
    }
    joined = own.join(near, "_k", "left")
    return joined.select("_k", *(F.when(d.isNotNull(), v).otherwise(F.col(c)).alias(c) for c, v in step.items()), "_ux", "_uy", d.isNotNull().alias("_moved"))


def target_area(settlements: DataFrame, extents: DataFrame, key: str, bounds: tuple[float, float, float, float], size: float, ring: str = "ring", kind: str = "type", x: str = "x", y: str = "y") -> DataFrame:
    """(key, x, y, type, ring): the Voronoi cell of each distinct place, cut to the extents; the parts that hold the settlement's point, as convex rings.

    A settlement whose point lies in none of its pieces has a circle of ``FALLBACK_BUFFER`` instead, with no type; so have
    all where there are fewer than four places. Of settlements at one place the smallest key stands for all.
    """
    places = settlements.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.min(key).alias(key)).select(key, x, y)
    circle = G.circle(F.col(x), F.col(y), S.FALLBACK_BUFFER)
    none = F.lit(None).cast("string")
    if places.limit(4).count() < 4:
        return places.select(key, x, y, none.alias(kind), F.array(circle).alias(ring))
    cells = voronoi_cells(places, key, bounds, x, y).select(key, x, y, F.array("ring").alias("_cell"))
    numbered = extents.select(F.xxhash64(kind, ring).alias("_e"), F.col(kind).alias(kind), F.array(ring).alias("_extent"))
    pieces = overlay(cells, numbered, "_cell", "_extent", size)
    hit = F.max(G.contains(F.col("piece"), F.col(x), F.col(y))).alias("_hit")
    kept = pieces.groupBy(key, x, y, kind, "_e").agg(hit, F.collect_list("piece").alias(ring)).where("_hit").select(key, x, y, kind, ring)
    kept = cut_lineage(kept)
    pending = places.join(kept.select(key).distinct(), key, "left_anti")
    return kept.unionByName(pending.select(key, x, y, none.alias(kind), F.array(circle).alias(ring)))
