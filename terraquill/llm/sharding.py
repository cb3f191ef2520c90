"""Minimax contiguous sharding of atomic groups.

Rows with equal texts form a group that must stay together. Groups stand in the order of their 64-bit text
hash; a shard is a contiguous run of groups. The capacity is the smallest C for which greedy filling needs
no more shards than there are, found by binary search, and the cuts are where that filling ends a shard.

The search runs on the driver over a bounded table of hash ranges with their bytes. A range in which a cut
may lie is refined, by one more aggregation, until it holds a single group: cuts are exact
however many groups there are, and the driver never sees more than ``MAX_RANGES`` ranges a round.
Since a shard is a range of hashes, rows get theirs by comparison with the cuts, without a join.

Defined cases: a null text has no bytes and one row of size 1, like an empty text, but is a group of its own. Repeated rows are rows
of one group. Texts whose 64-bit hashes are equal share a group. An empty table gives an empty result; with fewer groups than
shards some shards stay empty. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.llm.common import Scratch

FIRST_BITS = 14
NEXT_BITS = 10
MAX_RANGES = 1 << 20
#: Slices of a shard's rows in which slots are counted; only a slice is ranked in a window.
SLICES = 1024


@dataclass(frozen=True)
class Range:
    """Groups whose hash lies in [start, start + 2**bits), their bytes in all and those of the largest."""

    start: int
    bits: int
    bytes: int
    largest: int

    @property
    def single(self) -> bool:
        return self.largest == self.bytes


def _positions(ranges: list[Range], ends: list[int], capacity: int, shards: int, high: bool) -> list[tuple[int, int]]:
    """Where greedy filling with this capacity ends each shard: at least (or, if ``high``, at most) so many
    bytes from the start; and the last byte that the shard has room for. Both grow with the capacity."""
    at, out = 0, []
    for _ in range(shards):
        room = at + capacity
        k = bisect_right(ends, room)
        if k == len(ends):
            at = ends[-1] if ends else 0
        else:
            start = ends[k - 1] if k else 0
            if ranges[k].single:
                at = start
            else:  # some group ends less than the largest size before ``room``, or the range's start is the end
                at = room if high else max(start, room - ranges[k].largest)
        out.append((at, room))
    return out


def _least_capacity(ranges: list[Range], ends: list[int], shards: int, high: bool) -> int:
    """By binary search, the least capacity for which greedy filling reaches the end."""
    total = ends[-1] if ends else 0
    low, up = max([-(-total // shards), 1, *(r.largest for r in ranges)]), max(total, 1)
    while low < up:
        middle = (low + up) // 2
        if _positions(ranges, ends, middle, shards, high)[-1][0] >= total:
            up = middle
        else:
            low = middle + 1
    return low


def capacity_bounds(ranges: list[Range], shards: int) -> tuple[int, int, list[int]]:
    """Bounds of the smallest capacity, and the ranges of several groups in which a cut may lie for it."""
    ends, at = [], 0
    for r in ranges:
        at += r.bytes
        ends.append(at)
    least, most = _least_capacity(ranges, ends, shards, True), _least_capacity(ranges, ends, shards, False)
    early, late = _positions(ranges, ends, least, shards, False), _positions(ranges, ends, most, shards, True)
    found = set()
    for (a, _), (_, b) in zip(early[:-1], late[:-1]):
        k = bisect_right(ends, a)
        while k < len(ranges) and (ends[k - 1] if k else 0) <= b:
            if not ranges[k].single:
                found.add(k)
            k += 1
    return least, most, sorted(found)


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Least hashes of the 2nd, 3rd ... shard, and the capacity. ``groups``: place long (hash), bytes long."""

    def ranges_of(df: DataFrame, bits: int) -> list[Range]:
        # shiftright keeps the sign, so equal high bits stay together and in order.
        rows = (
            df.groupBy(F.shiftright("place", bits).alias("high"))
            .agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
            .collect()
        )
        return [Range(r["high"] << bits, bits, r["bytes"], r["largest"]) for r in rows]

    ranges = sorted(ranges_of(groups, 64 - FIRST_BITS), key=lambda r: r.start)
    while True:
        _, capacity, todo = capacity_bounds(ranges, shards)
        if not todo:
            break
        # The widest first: each round narrows them by NEXT_BITS.
        widest = max(ranges[k].bits for k in todo)
        chosen = [k for k in todo if ranges[k].bits == widest][: MAX_RANGES >> NEXT_BITS]
        runs: list[list[int]] = []
        for r in (ranges[k] for k in chosen):
            if runs and runs[-1][1] == r.start:
                runs[-1][1] = r.start + (1 << widest)
            else:
                runs.append([r.start, r.start + (1 << widest)])
        inside = reduce(Column.__or__, (F.col("place").between(a, b - 1) for a, b in runs))
        finer = ranges_of(groups.where(inside), max(0, widest - NEXT_BITS))
        kept = set(range(len(ranges))) - set(chosen)
        ranges = sorted([*(ranges[k] for k in kept), *finer], key=lambda r: r.start)
    ends, at = [], 0
    for r in ranges:
        at += r.bytes
        ends.append(at)
    cuts = []
    for position, _ in _positions(ranges, ends, capacity, shards, False):
        k = bisect_right(ends, position)
        if k < len(ranges):
            cuts.append(ranges[k].start)
    return cuts, capacity


def assign_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    place = F.when(text.isNull(), F.xxhash64(F.lit("null text"), F.lit(True))).otherwise(F.xxhash64(text))
    groups = scratch.save(
        docs.select(place.alias("place"), size.alias("bytes")).groupBy("place").agg(F.sum("bytes").alias("bytes")),
        "groups",
    )
    cuts, _ = plan_cuts(groups, shards)
    scratch.drop("groups")
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("place") >= cut).cast("int")
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        place.alias("place"),
        F.pmod(F.when(F.col(id_col).isNull(), place).otherwise(F.xxhash64(F.col(id_col), F.lit(11))), F.lit(SLICES)).cast("int").alias("slice"),
    ).withColumn("shard", shard)
    # Slots: a bounded table of counts by shard and slice, and a rank inside each slice.
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "place"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
    )
