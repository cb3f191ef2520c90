"""Visitation and coverage: gridded and buffered tracking, rounds, sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import rules as R
from terraquill.operators import aggregates as A
from terraquill.operators import relational as L
from terraquill.operators import spatial


@dataclass(frozen=True)
class Day:
    """A campaign day; on the mop-up day what isn't visited won't be."""

    number: int
    mop_up: bool = False


def valid_tracks(tracks: DataFrame, speed: str = "speed", ts: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Points of slow movement in working hours with coordinates."""
    return tracks.where((F.col(speed) < 1) & F.hour(ts).between(7, 16) & F.col(x).isNotNull() & F.col(y).isNotNull())


def cell_summary(cells: DataFrame, tracks: DataFrame, key: str, cell: str, ring: str, size: float = S.GRID_SIZE_BUILT_UP) -> DataFrame:
    """(key, visited, not_yet_visited, total, coverage, visitation) from cells and the tracks inside them; a
    cell that was visited before stays visited."""
    hit = spatial.polygons_hit(cells, tracks, cell, ring, size=size)
    before = F.col("visitation") if "visitation" in cells.columns else F.lit(None).cast("string")
    status = R.visited(before, F.when(F.col("hit"), S.VISITED))
    matrix = A.status_matrix(hit.withColumn("_status", status), [key], cell, "_status", (S.VISITED, S.NOT_YET_VISITED))
    return matrix.withColumn("visitation", F.when(F.col("visited") > 0, S.VISITED).otherwise(S.NOT_YET_VISITED))


def update_plan(plan: DataFrame, summary: DataFrame, key: str, day: Day) -> DataFrame:
    """The plan with the day's status, cumulative status, coverage and their classes. ``plan`` may hold the columns of earlier days."""
    n = day.number
    joined = plan.join(summary, key, "left")
    previous = F.col(f"day_{n - 1}_cumm") if f"day_{n - 1}_cumm" in plan.columns else F.lit(None).cast("string")
    joined = joined.withColumn("_cum", R.visited(F.col("visitation"), previous))
    before = F.col("prev_coverage") if "prev_coverage" in plan.columns else F.lit(None).cast("double")
    final = R.mop_up(F.col("_cum")) if day.mop_up else F.col("_cum")
    day_column = F.col(f"day_{n}") if f"day_{n}" in plan.columns else F.lit("Yes")
    return (
        joined.withColumn(f"day_{n}", R.day_status(day_column, final))
        .withColumn(f"day_{n}_cumm", final)
        .withColumn("final_coverage", R.final_coverage(F.col("coverage"), before))
        .withColumn("settlement_coverage", R.coverage_class(F.col("final_coverage")))
        .withColumn("time_spent", R.time_spent_class(F.col("track_count")))
        .drop("_cum", "visitation")
    )


def gridded_tracking(plan: DataFrame, cells: DataFrame, extents: DataFrame, tracks: DataFrame, key: str, day: Day) -> DataFrame:
    """Coverage of planned settlements from cells (key, cell, ring) and extents (key, ring): one lazy plan."""
    cell_side = cell_summary(cells, tracks, key, "cell", "ring")
    counts = spatial.count_points(extents.select(key, "ring"), tracks, key, "ring", name="track_count")
    summary = cell_side.join(counts.select(key, "track_count"), key, "left").fillna(0, ["track_count"])
    return update_plan(plan, summary.select(key, "coverage", "visitation", "track_count"), key, day)


def buffer_tracking(settlements: DataFrame, tracks: DataFrame, key: str, track_key: str, day: Day, radius: float = S.BUFFER_METRES) -> DataFrame:
    """Settlements visited if a track point lies within the radius."""
    near = spatial.within(settlements, tracks, radius, key, track_key, name="_near")
    status = F.when(F.col("_near"), S.VISITED).otherwise(S.NOT_YET_VISITED)
    return near.withColumn("visitation", R.mop_up(status) if day.mop_up else status).drop("_near")


def triangulate(settlements: DataFrame, sources: dict[str, DataFrame], key: str, source_key: str, radius: float = S.BUFFER_METRES) -> DataFrame:
    """Which sources hold each settlement, by key or by a point within the radius. A source that has no ``key`` column counts by
    coordinates only, one without x and y by key only."""
    out, hits = settlements, {}
    for k, (name, df) in enumerate(sources.items()):
        flags = []
        if key in df.columns:
            out = L.exists_in(out, df.where(F.col(key).isNotNull()), [key], f"_k{k}")
            flags.append(F.col(f"_k{k}"))
        if {"x", "y"} <= set(df.columns):
            out = spatial.within(out, df.where("x is not null and y is not null"), radius, key, source_key, name=f"_p{k}")
            flags.append(F.col(f"_p{k}"))
        hits[name] = flags[0] | flags[1] if len(flags) == 2 else flags[0]
    names, reach, status = R.reach(hits)
    drop = [c for c in out.columns if c.startswith(("_k", "_p"))]
    return out.withColumn("sources", names).withColumn("reach", reach).withColumn("status", status).drop(*drop)


def contact_analysis(base: DataFrame, rounds: dict[str, DataFrame], keys: list[str], row_id: str) -> DataFrame:
    """Per settlement and round the harmonized visit and coverage over all keys; then contacts and the usual coverage.

    ``rounds``: tables with the keys, ``visitation`` and ``coverage``.
    """
    out = base
    for name, df in rounds.items():
        have = [k for k in keys if k in df.columns]
        out = L.fallback_join(out, df, have, row_id, ["visitation", "coverage"])
        visits = [F.col("matches")[j]["visitation"] for j in range(len(have))]
        covers = [F.col("matches")[j]["coverage"] for j in range(len(have))]
        out = out.withColumn(f"{name}_visit", R.harmonized_visit(visits)).withColumn(f"{name}_coverage", R.harmonized_coverage(covers)).drop("matches")
    seen, share = R.contact([F.col(f"{n}_visit") for n in rounds])
    mode = R.row_mode([F.col(f"{n}_coverage") for n in rounds])
    return out.withColumn("contact", seen).withColumn("contact_proportion", share).withColumn("coverage", mode)


def reassess(summary: DataFrame, status: str = "visitation", area: str = "area_sqm", tracks: str = "track_count", coverage: str = "coverage") -> DataFrame:
    """``review`` (maintain or reevaluate), and for visits to reevaluate, with too few track points for their area, the status back to not yet visited and
    coverage and count back to 0. A null status, area or count is no visit to reevaluate."""
    again = F.coalesce(R.needs_reassessment(F.col(status), F.col(area), F.col(tracks)), F.lit(False))
    types = dict(summary.dtypes)
    back = {c: F.when(again, F.lit(0)).otherwise(F.col(c)).cast(types[c]) for c in (coverage, tracks)}
    return summary.withColumns({"review": F.when(again, "reevaluate").otherwise("maintain"), status: F.when(again, S.NOT_YET_VISITED).otherwise(F.col(status)), **back})
