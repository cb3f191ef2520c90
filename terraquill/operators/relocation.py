"""Settlements that stand too near to another one, moved inside their ward or onto an extent."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import geometry as G
from terraquill.operators import spatial
from terraquill.operators.graph import cut_lineage
from terraquill.operators.tables import Rounds

#: Steps to the eight sides in the order in which they are tried (fixed values): right, left, up, down, then the diagonals.
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))
#: Two points can come into each other's way only within this distance: both move diagonally, and the least distance.
REACH = 2 * S.SHIFT_DISTANCE * math.sqrt(2) + S.MIN_DISTANCE


def nearest_centre(points: DataFrame, key: str, extents: DataFrame, extent: str, ring: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, centre_x, centre_y): the centre of the nearest extent, ties to the smallest extent key. The radius doubles for points that
    have found none."""
    centre = G.centroid(F.col(ring))
    centres = cut_lineage(extents.select(F.col(extent).alias("_e"), centre[0].alias(x), centre[1].alias(y)))
    todo, found = points.select(key, x, y), []
    while not (todo.isEmpty() or centres.isEmpty()):
        near = cut_lineage(spatial.nearest(todo, centres, radius, key, "_e", x, y))
        found.append(near.where("near__e is not null").select(key, F.col("near__e").alias("_e")))
        todo = near.where("near__e is null").select(key, x, y)
        radius *= 2
    named = centres.select("_e", F.col(x).alias("centre_x"), F.col(y).alias("centre_y"))
    if not found:
        none = F.lit(None).cast("double")
        return todo.select(key, none.alias("centre_x"), none.alias("centre_y")).limit(0)
    return reduce(DataFrame.unionByName, found).join(named, "_e").drop("_e")


def _order(key: str) -> Column:
    """Turns in an order that has nothing to do with the place, so that few rounds are needed."""
    return F.struct(F.xxhash64(F.lit(7), key).alias("h"), F.col(key).alias("k"))


def move_within_wards(
    points: DataFrame, key: str, wards: DataFrame, ward: str, ward_ring: str, extents: DataFrame, extent: str, extent_ring: str,
    flag: str = "too_near", x: str = "x", y: str = "y",
) -> DataFrame:
    """The points with ``x_new`` and ``y_new``.

    Points without the flag stay and hold nobody off. Flagged points have turns, by a hash of the key. In its turn a point takes the first of these places that has no
    place taken earlier nearer than ``MIN_DISTANCE`` (the very same place doesn't count): its own, then ``SHIFT_DISTANCE`` to each
    of the eight sides, as long as that lies in its ward. If there is none, it goes to the centre of the nearest extent, where any number may stand; such points hold
    nobody off. Without extents, or without coordinates, it stays.

    All points that are first among those in reach have their turn at once, from one written table to the next: a round costs joins on grid
    cells, and no ward or cell is gathered. With them settle all waiting points whose place is the very same: nothing between their turns can hold it off.
    Places that are held off go away at the end of each round, so that a crowd is settled after as many rounds as places fit into its reach, however many stand there.
    """
    rounds = Rounds(points.sparkSession, "moves")
    placed = points.where(F.col(flag) & F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = placed.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    inside = spatial.points_in_polygons(placed, wards.select(F.col(ward).alias("_ward"), F.col(ward_ring).alias("_wr")), "_wr", "_x", "_y", REACH)
    homes = inside.groupBy("_key").agg(F.min("_ward").alias("_home"))
    steps = F.array(*(F.struct(F.lit(n).alias("_slot"), F.lit(i * S.SHIFT_DISTANCE).alias("_dx"), F.lit(j * S.SHIFT_DISTANCE).alias("_dy")) for n, (i, j) in enumerate(DIRECTIONS, 1)))
    tried = placed.join(homes, "_key").select("*", F.inline(steps)).withColumns({"_sx": F.col("_x") + F.col("_dx"), "_sy": F.col("_y") + F.col("_dy")})
    tried = spatial.points_in_polygons(tried, wards.select(F.col(ward).alias("_ward"), F.col(ward_ring).alias("_wr")), "_wr", "_sx", "_sy", REACH)
    columns = ["_key", "_slot", "_sx", "_sy", "_cx", "_cy"]
    celled = lambda d: d.withColumns({"_cx": G.cell(F.col("_x"), REACH), "_cy": G.cell(F.col("_y"), REACH)}).select(*columns)
    own = celled(placed.withColumns({"_slot": F.lit(0), "_sx": F.col("_x"), "_sy": F.col("_y")}))
    spots = own.unionByName(celled(tried.where("_ward = _home").dropDuplicates(["_key", "_slot"])))
    spots = rounds.save(spots.withColumn("_o", _order("_key")), "spots")

    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    settled: list[DataFrame] = []
    n = 0
    while True:
        first = F.min(F.struct("_slot", "_sx", "_sy")).alias("_spot")
        waiting = spots.groupBy("_key", "_o", "_cx", "_cy").agg(first)
        low = spots.groupBy("_cx", "_cy").agg(F.min("_o").alias("_low")).select("_cx", "_cy", "_low", F.inline(around))
        low = low.groupBy((F.col("_cx") + F.col("i")).alias("_cx"), (F.col("_cy") + F.col("j")).alias("_cy")).agg(F.min("_low").alias("_low"))
        holders = waiting.join(low, ["_cx", "_cy"]).where("_o = _low").select(F.col("_key").alias("_holder"), F.col("_spot._sx").alias("_hx"), F.col("_spot._sy").alias("_hy"))
        taken = rounds.save(holders.groupBy("_hx", "_hy").agg(F.min("_holder").alias("_holder")), f"taken{n}")
        if taken.isEmpty():
            break
        same = (F.col("_spot._sx") == F.col("_hx")) & (F.col("_spot._sy") == F.col("_hy"))
        turn = rounds.save(waiting.join(taken, same).select("_key", "_spot._sx", "_spot._sy"), f"turn{n}")
        settled.append(turn)
        ids = spots.join(turn.select("_key"), "_key", "left_anti").withColumn("_id", F.struct("_key", "_slot"))
        held = spatial.near_pairs(taken.withColumnsRenamed({"_hx": "_sx", "_hy": "_sy"}), ids, S.MIN_DISTANCE, "_holder", "_id", "_sx", "_sy")
        held = held.where((F.col("distance") > 0) & (F.col("distance") < S.MIN_DISTANCE)).select(F.col("_b").alias("_id")).distinct()
        spots = rounds.save(ids.join(held, "_id", "left_anti").drop("_id"), f"spots{n}")
        rounds.drop(f"taken{n}", f"spots{n - 1}" if n else "spots")
        n += 1

    none = placed.select("_key", F.col("_x").alias("_sx"), F.col("_y").alias("_sy")).limit(0)
    done = rounds.save(reduce(DataFrame.unionByName, settled, none), "done")
    crowded = placed.join(done, "_key", "left_anti").select(F.col("_key").alias(key), F.col("_x").alias(x), F.col("_y").alias(y))
    centres = nearest_centre(crowded, key, extents, extent, extent_ring, REACH, x, y)
    done = done.unionByName(centres.select(F.col(key).alias("_key"), F.col("centre_x").alias("_sx"), F.col("centre_y").alias("_sy")))
    moved = points.join(done, F.col(key) == F.col("_key"), "left")
    return moved.withColumns(
        {"x_new": F.coalesce("_sx", F.col(x).cast("double")), "y_new": F.coalesce("_sy", F.col(y).cast("double"))}
    ).drop("_key", "_sx", "_sy")
