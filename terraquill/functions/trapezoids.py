"""Trapezoids of polygons: small helpers on the few edges of one tile."""

from __future__ import annotations

from terraquill.functions.clip import Point, clip_ring, signed_area

#: Of a tile's width: slabs narrower than this hold nothing.
SLIVER = 1e-10


def _crossings(edges: list[tuple]) -> list[float]:
    """The x of all proper crossings of edges, each given from left to right."""
    out = []
    for k, (ax, ay, bx, by, _) in enumerate(edges):
        for cx, cy, dx, dy, _ in edges[k + 1 :]:
            if cx >= bx or dx <= ax or min(cy, dy) > max(ay, by) or max(cy, dy) < min(ay, by):
                continue
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                x = ax + t * (bx - ax)
                if max(ax, cx) < x < min(bx, dx):
                    out.append(x)
    return out


def trapezoids(polygons: list[list[list[Point]]]) -> list[list[Point]]:
    """Disjoint trapezoids with two upright sides (or one) that cover what lies in any of the polygons. A polygon is a list of rings;
    what an even number of its rings holds is outside, so a ring inside another one is a hole."""
    edges = []
    for n, rings in enumerate(polygons):
        for ring in rings:
            for p, q in zip(ring, ring[1:] + ring[:1]):
                if p[0] != q[0]:
                    a, b = (p, q) if p[0] < q[0] else (q, p)
                    edges.append((*a, *b, n))
    if not edges:
        return []
    xs = sorted({x for e in edges for x in (e[0], e[2])} | set(_crossings(edges)))
    least = SLIVER * (xs[-1] - xs[0])
    at = lambda e, x: e[1] if x <= e[0] else e[3] if x >= e[2] else e[1] + (x - e[0]) / (e[2] - e[0]) * (e[3] - e[1])
    edges.sort()
    out: list[list[Point]] = []
    going: dict[tuple[int, int], float] = {}
    active: list[int] = []
    following, left = 0, xs[0]

    def close(pair: tuple[int, int], start: float, end: float) -> None:
        low, high = edges[pair[0]], edges[pair[1]]
        corners = [(start, at(low, start)), (end, at(low, end)), (end, at(high, end)), (start, at(high, start))]
        ring = [c for k, c in enumerate(corners) if c != corners[k - 1]]
        if len(ring) > 2:
            out.append(ring)

    for right in xs[1:]:
        if right - left <= least:
            continue
        mid = (left + right) / 2
        while following < len(edges) and edges[following][0] < mid:
            active.append(following)
            following += 1
        active = [k for k in active if edges[k][2] > mid]
        held: set[int] = set()
        pairs = []
        low = None
        for k in sorted(active, key=lambda k: at(edges[k], mid)):
            held ^= {edges[k][4]}
            if held and low is None:
                low = k
            elif not held:
                if at(edges[k], mid) > at(edges[low], mid):
                    pairs.append((low, k))
                low = None
        now = dict.fromkeys(pairs, left)
        for pair, start in going.items():
            if pair in now:
                now[pair] = start
            else:
                close(pair, start, left)
        going, left = now, right
    for pair, start in going.items():
        close(pair, start, left)
    return out


def shared_area(a: list[list[Point]], b: list[list[Point]]) -> list[list[Point]]:
    """The pieces of convex rings ``a`` inside convex rings ``b``, with area."""
    met = (clip_ring(p, q) for p in a for q in b if _boxes_meet(p, q))
    return [r for r in met if len(r) > 2 and abs(signed_area(r)) > 0]


def _boxes_meet(p: list[Point], q: list[Point]) -> bool:
    return all(min(x[k] for x in p) < max(x[k] for x in q) and min(x[k] for x in q) < max(x[k] for x in p) for k in (0, 1))
