"""Convex clipping and Voronoi cells, run as Arrow UDFs on candidate pairs only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
RING = "array<struct<x:double,y:double>>"


def _cut(ring: list[Point], a: float, b: float, c: float) -> list[Point]:
    """The part of a ring with a*x + b*y <= c."""
    out: list[Point] = []
    for k, p in enumerate(ring):
        q = ring[(k + 1) % len(ring)]
        dp, dq = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if dp <= 0:
            out.append(p)
        if (dp < 0 < dq) or (dq < 0 < dp):
            t = dp / (dp - dq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def signed_area(ring: list[Point]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def clip_ring(ring: list[Point], convex: list[Point]) -> list[Point]:
    """The part of any ring inside a convex one, of either orientation (Sutherland-Hodgman)."""
    sign = 1 if signed_area(convex) > 0 else -1
    for p, q in zip(convex, convex[1:] + convex[:1]):
        if p == q or not ring:
            continue
        a, b = sign * (q[1] - p[1]), -sign * (q[0] - p[0])
        ring = _cut(ring, a, b, a * p[0] + b * p[1])
    return ring


def _points(ring) -> list[Point]:
    pts = [(p["x"], p["y"]) for p in ring]
    return pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts


def _ring(points: list[Point]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in (points + points[:1] if len(points) > 2 else [])]


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and row of the corners of all rings, without the repeated first one."""
    values, many = rings.flatten(), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    row, last = np.repeat(np.arange(len(many)), many), np.cumsum(many) - 1
    some = many > 1
    first, last = (last - many + 1)[some], last[some]
    open_ = np.ones(len(x), bool)
    open_[last] = (x[first] != x[last]) | (y[first] != y[last])
    return x[open_], y[open_], row[open_]


def _intersections(ring: pa.Array, convex: pa.Array) -> pa.Array:
    """``clip_ring`` for all rows of a batch at once, side by side of the convex rings."""
    n = len(ring)
    x, y, row = _flat(ring)
    cx, cy, crow = _flat(convex)
    sides = np.bincount(crow, minlength=n)
    start = np.cumsum(sides) - sides
    after = np.arange(1, len(cx) + 1)
    after[(start + sides - 1)[sides > 0]] = start[sides > 0]
    sign = np.where(np.bincount(crow, cx * cy[after] - cx[after] * cy, n) > 0, 1.0, -1.0)
    for k in range(int(sides.max(initial=0))):
        a, b, c = np.zeros(n), np.zeros(n), np.zeros(n)
        has = np.flatnonzero(sides > k)
        p = start[has] + k
        q = after[p]
        a[has], b[has] = sign[has] * (cy[q] - cy[p]), -sign[has] * (cx[q] - cx[p])
        c[has] = a[has] * cx[p] + b[has] * cy[p]
        many = np.bincount(row, minlength=n)
        first = np.cumsum(many) - many
        nxt = np.arange(1, len(x) + 1)
        nxt[(first + many - 1)[many > 0]] = first[many > 0]
        d = a[row] * x + b[row] * y - c[row]
        e = d[nxt]
        keep, cross = d <= 0, ((d < 0) & (e > 0)) | ((e < 0) & (d > 0))
        end = np.cumsum(keep.astype(np.int64) + cross)
        new_x, new_y, new_row = (np.empty(end[-1] if len(end) else 0, v.dtype) for v in (x, y, row))
        t = d[cross] / (d[cross] - e[cross])
        new_x[end[cross] - 1] = x[cross] + t * (x[nxt[cross]] - x[cross])
        new_y[end[cross] - 1] = y[cross] + t * (y[nxt[cross]] - y[cross])
        new_row[end[cross] - 1] = row[cross]
        at = (end - cross - 1)[keep]
        new_x[at], new_y[at], new_row[at] = x[keep], y[keep], row[keep]
        x, y, row = new_x, new_y, new_row
    many = np.bincount(row, minlength=n)
    kept = many[row] > 2
    x, y, many = x[kept], y[kept], np.where(many > 2, many, 0)
    # The first corner once more at the end of each ring.
    ends = np.cumsum(many)[many > 0]
    firsts = ends - many[many > 0]
    x, y = np.insert(x, ends, x[firsts]), np.insert(y, ends, y[firsts])
    offsets = np.concatenate([[0], np.cumsum(np.where(many > 0, many + 1, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))


def intersection(ring: Column, convex: Column) -> Column:
    """The part of a ring inside a convex ring; an empty array if there is none."""
    return F.arrow_udf(_intersections, RING)(ring, convex)


FLAGGED = "array<struct<x:double,y:double,ok:boolean>>"


def cut_flagged(seed: Point, others: list[Point], ring: list[tuple[float, float, bool]], same: float, in_order: bool = False) -> list[tuple[float, float, bool]]:
    """A convex ring around a seed without what is nearer to one of the others. Corners that stay keep their flag, new ones have False; a
    corner within ``same`` of a cut stays as it is. ``in_order``: the others come nearest first; none is looked at beyond twice the farthest corner's distance."""
    reach = math.inf
    for o in others if in_order else sorted(others, key=lambda p: (math.dist(seed, p), p)):
        length = math.dist(seed, o)
        if not length:
            continue
        if length > 2 * reach:
            break
        a, b = (o[0] - seed[0]) / length, (o[1] - seed[1]) / length
        off = [a * (p[0] - seed[0]) + b * (p[1] - seed[1]) - length / 2 for p in ring]
        out = []
        for k, (p, dp) in enumerate(zip(ring, off)):
            q, dq = ring[(k + 1) % len(ring)], off[(k + 1) % len(ring)]
            if dp <= same:
                out.append(p)
            if (dp < -same and dq > same) or (dp > same and dq < -same):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]), False))
        if out != ring:
            ring = out
            reach = max((math.dist(seed, p[:2]) for p in ring), default=0.0)
    return ring


def _cut_corners(x: pd.Series, y: pd.Series, others: pd.Series, ring: pd.Series, same: pd.Series) -> pd.Series:
    found = []
    for a, b, o, r, s in zip(x, y, others, ring, same):
        corners = [(p["x"], p["y"], bool(p["ok"])) for p in r]
        cut = cut_flagged((a, b), [(p["x"], p["y"]) for p in o], corners, s) if len(o) else corners
        found.append([{"x": px, "y": py, "ok": ok} for px, py, ok in cut])
    return pd.Series(found)


def cut_corners(x: Column, y: Column, others: Column, ring: Column, same: Column) -> Column:
    """``cut_flagged`` for each row."""
    return F.pandas_udf(_cut_corners, FLAGGED)(x, y, others, ring, same)
