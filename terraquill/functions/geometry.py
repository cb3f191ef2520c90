"""Geometry as Column expressions: projections, distances, cells, rings. A ring is array<struct<x, y>>, closed or not."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_R = 6378137.0
_F = 1 / 298.257223563


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857."""
    x = F.radians(lon) * _R
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * _R
    return x, y


def utm(lon: Column, lat: Column, zone: int = 31) -> tuple[Column, Column]:
    """Northern UTM by the Krueger series to third order: EPSG:32631 for zone 31, 32632 for zone 32."""
    n = _F / (2 - _F)
    a = _R / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alpha, 1):
        x = x + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * a * x, 0.9996 * a * y


def degrees_of(metres: Column | float) -> Column | float:
    return metres / 1000 / 111.11


def metres_of(degrees: Column | float) -> Column | float:
    return degrees * 111.11 * 1000


def is_geographic(epsg: int) -> bool:
    return epsg == 4326


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


#: Fixed number of steps: where Vincenty's iteration converges at all, it gains two digits or more in each.
VINCENTY_STEPS = 12


def _inverse_step(lam: Column, lon: Column, u1: Column, u2: Column) -> dict[str, Column]:
    """One step of Vincenty's inverse solution: the quantities at a difference ``lam`` of longitudes on the auxiliary sphere."""
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    sin_s = F.sqrt(F.pow(c2 * F.sin(lam), 2) + F.pow(c1 * s2 - s1 * c2 * F.cos(lam), 2))
    cos_s = s1 * s2 + c1 * c2 * F.cos(lam)
    sigma = F.atan2(sin_s, cos_s)
    sin_a = F.when(sin_s == 0, F.lit(0.0)).otherwise(c1 * c2 * F.sin(lam) / F.when(sin_s == 0, F.lit(1.0)).otherwise(sin_s))
    cos2_a = 1 - sin_a * sin_a
    cos_m = F.when(cos2_a <= 1e-15, F.lit(0.0)).otherwise(cos_s - 2 * s1 * s2 / F.when(cos2_a <= 1e-15, F.lit(1.0)).otherwise(cos2_a))
    k = _F / 16 * cos2_a * (4 + _F * (4 - 3 * cos2_a))
    new = lon + (1 - k) * _F * sin_a * (sigma + k * sin_s * (cos_m + k * cos_s * (2 * cos_m * cos_m - 1)))
    return {"sin_s": sin_s, "cos_s": cos_s, "sigma": sigma, "cos2_a": cos2_a, "cos_m": cos_m, "lam": new}


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the WGS84 ellipsoid by Vincenty's inverse solution, to the millimetre. Points so nearly opposite each other that its iteration doesn't
    settle get ``great_ellipse`` instead; a point of null coordinates has no distance."""
    u1, u2 = (F.atan((1 - _F) * F.tan(F.radians(p))) for p in (lat1, lat2))
    lon = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    # The steps are a fold over their numbers, so that the expression doesn't grow with them.
    start = F.struct(lon.alias("lam"), F.lit(9.0).alias("last"), *(F.lit(0.0).alias(n) for n in ("sin_s", "cos_s", "sigma", "cos2_a", "cos_m")))

    def step(state: Column, _: Column) -> Column:
        q = _inverse_step(state["lam"], lon, u1, u2)
        return F.struct(q["lam"].alias("lam"), state["lam"].alias("last"), *(q[n].alias(n) for n in ("sin_s", "cos_s", "sigma", "cos2_a", "cos_m")))

    def metres(q: Column) -> Column:
        b = _R * (1 - _F)
        u = q["cos2_a"] * (_R * _R - b * b) / (b * b)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        c2 = q["cos_m"] * q["cos_m"]
        inner = q["cos_s"] * (2 * c2 - 1) - big_b / 6 * q["cos_m"] * (4 * q["sin_s"] * q["sin_s"] - 3) * (4 * c2 - 3)
        shift = big_b * q["sin_s"] * (q["cos_m"] + big_b / 4 * inner)
        return F.when(F.abs(q["lam"] - q["last"]) < 1e-11, b * big_a * (q["sigma"] - shift))

    steps = F.sequence(F.lit(1), F.lit(VINCENTY_STEPS))
    settled = F.aggregate(steps, start, step, metres)
    same = (lat1 == lat2) & (F.sin(lon / 2) == 0)
    return F.when(lat1.isNull() | lat2.isNull() | lon.isNull(), None).when(same, F.lit(0.0)).otherwise(F.coalesce(settled, great_ellipse(lat1, lon1, lat2, lon2)))


def great_ellipse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The great circle of the reduced latitudes with Lambert's flattening correction: within a metre over the distances of a ward, within
    about 20 km near the opposite point."""
    b1, b2 = (F.atan((1 - _F) * F.tan(F.radians(p))) for p in (lat1, lat2))
    half = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    sigma = 2 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    safe = F.when(sigma == 0, F.lit(1.0)).otherwise(sigma)
    near, far = F.pow(F.cos(safe / 2), 2), F.pow(F.sin(safe / 2), 2)
    x = F.when(near < 1e-9, F.lit(0.0)).otherwise((safe - F.sin(safe)) * F.pow(F.sin(p) * F.cos(q), 2) / F.when(near < 1e-9, F.lit(1.0)).otherwise(near))
    y = (safe + F.sin(safe)) * F.pow(F.cos(p) * F.sin(q), 2) / far
    return F.when(sigma == 0, F.lit(0.0)).otherwise(_R * (safe - _F / 2 * (x + y)))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring of a rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def circle(x: Column, y: Column, radius: float, sides: int = 64) -> Column:
    """A buffer around a point as a regular polygon."""
    angles = [2 * math.pi * k / sides for k in range(sides)]
    points = [
        F.struct((x + radius * math.cos(a)).alias("x"), (y + radius * math.sin(a)).alias("y")) for a in (*angles, angles[0])
    ]
    return F.array(*points)


def _edges(ring: Column) -> Column:
    """Pairs of successive corners, from the last to the first as well."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(ring: Column) -> Column:
    """Planar area by the shoelace formula."""
    twice = F.aggregate(
        _edges(ring),
        F.lit(0.0),
        lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"],
    )
    return F.abs(twice) / 2


def centroid(ring: Column) -> list[Column]:
    """x and y of a ring's centre of area; places are taken from its first corner, so that great coordinates lose nothing."""
    first = F.get(ring, F.lit(0))
    turn = lambda e: (e["a"]["x"] - first["x"]) * (e["b"]["y"] - first["y"]) - (e["b"]["x"] - first["x"]) * (e["a"]["y"] - first["y"])
    add = lambda value: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + value(e))
    thrice = 3 * add(turn)
    return [first[c] + add(lambda e, c=c: (e["a"][c] + e["b"][c] - 2 * first[c]) * turn(e)) / thrice for c in ("x", "y")]


def bounds(ring: Column) -> list[Column]:
    """x_min, y_min, x_max, y_max."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [f(v).alias(name) for f, v, name in ((F.array_min, xs, "x_min"), (F.array_min, ys, "y_min"), (F.array_max, xs, "x_max"), (F.array_max, ys, "y_max"))]


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast. A lower or left edge is inside, an upper or right one outside."""
    crossings = F.aggregate(
        _edges(ring),
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1
