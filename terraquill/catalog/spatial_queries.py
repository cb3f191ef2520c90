"""Spatial joins, projections and grids on the plane of derived coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill import settings as S
from terraquill.catalog.base import SETTLEMENTS, TRACKS, query, settlements, table, tracks
from terraquill.functions import geometry as G
from terraquill.functions import rules as R
from terraquill.operators import overlay, relocation, spatial, tessellation, voronoi
from terraquill.plans import target_area as areas

#: Extents: a square of 150 m for each nation.
_EXTENTS = "extents AS (SELECT n_nationkey AS extent, CAST(n_nationkey * 173 % 850 AS DOUBLE) AS x0, CAST(n_nationkey * 311 % 850 AS DOUBLE) AS y0 FROM nation)"
_INSIDE = "t.x >= x0 AND t.x < x0 + 150 AND t.y >= y0 AND t.y < y0 + 150"


def extents(spark, sf_dir):
    k = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(
        k.alias("extent"), (k * 173 % 850).cast("double").alias("x0"), (k * 311 % 850).cast("double").alias("y0")
    )
    x0, y0 = F.col("x0"), F.col("y0")
    return e.withColumn("ring", G.box(x0, y0, x0 + 150, y0 + 150))


@query(f"""WITH {SETTLEMENTS}, {_EXTENTS} SELECT key, extent FROM settlements t JOIN extents ON {_INSIDE}""")
def point_in_polygon(spark, sf_dir):
    s = settlements(spark, sf_dir).select("key", "x", "y")
    return spatial.points_in_polygons(s, extents(spark, sf_dir), "ring").select("key", "extent")


@query(f"""WITH {TRACKS}, {_EXTENTS}, c AS (SELECT extent, count(*) AS n FROM tracks t JOIN extents ON {_INSIDE} GROUP BY 1) SELECT extent, coalesce(n, 0) AS n FROM extents LEFT JOIN c USING (extent)""")
def extent_track_count(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return spatial.count_points(extents(spark, sf_dir), t, "extent", "ring").select("extent", "n")


@query(f"""WITH {TRACKS}, c AS (SELECT DISTINCT CAST(floor(x / 20) AS BIGINT) AS i, CAST(floor(y / 20) AS BIGINT) AS j FROM tracks),
g AS (SELECT i, j FROM (SELECT unnest(range(50)) AS i), (SELECT unnest(range(50)) AS j)) SELECT g.i, g.j, c.i IS NOT NULL AS hit FROM g LEFT JOIN c ON g.i = c.i AND g.j = c.j""")
def grid_visited(spark, sf_dir):
    i, j = F.col("i") * 20.0, F.col("j") * 20.0
    cells = spark.range(2500).select(F.floor(F.col("id") / 50).alias("i"), (F.col("id") % 50).alias("j"), "id").withColumn("ring", G.box(i, j, i + 20, j + 20))
    return spatial.polygons_hit(cells, tracks(spark, sf_dir), "id", "ring", size=20.0).select("i", "j", "hit")


@query(f"""WITH {SETTLEMENTS}, {_EXTENTS} SELECT key FROM settlements t WHERE NOT EXISTS (SELECT 1 FROM extents WHERE {_INSIDE})""")
def membership_anti(spark, sf_dir):
    s = settlements(spark, sf_dir).select("key", "x", "y")
    return spatial.outside_all(s, extents(spark, sf_dir), "key", "ring").select("key")


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT DISTINCT CAST(event_id * 53 % 1000 AS DOUBLE) AS tx, CAST(event_id * 17 % 1000 AS DOUBLE) AS ty FROM events)
SELECT key, EXISTS (SELECT 1 FROM t WHERE sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) <= 12) AS visited FROM settlements""")
def buffer_any(spark, sf_dir):
    return spatial.within(settlements(spark, sf_dir).select("key", "x", "y"), tracks(spark, sf_dir), 12.0, "key", "event_id", name="visited").select("key", "visited")


_PAIRS = """p AS (SELECT a.key, b.key AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM settlements a JOIN settlements b ON a.key <> b.key
  AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60)"""


@query(f"""WITH {SETTLEMENTS}, {_PAIRS}, f AS (SELECT key, count(*) AS n_near, max(d) AS distance FROM p WHERE d <= 60 GROUP BY key)
SELECT key, coalesce(n_near, 0) AS n_near, round(distance, 6) AS distance, CASE WHEN distance IS NULL THEN NULL WHEN distance <= 20 THEN 'Within 10m' ELSE 'Within 30m' END AS proximity_issues
FROM settlements LEFT JOIN f USING (key)""")
def farthest_within_class(spark, sf_dir):
    n = spatial.neighbours(settlements(spark, sf_dir).select("key", "x", "y"), 60.0, "key", farthest=True)
    return n.select("key", "n_near", F.round("distance", 6).alias("distance"), R.distance_class(F.col("distance")).alias("proximity_issues"))


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT min(event_id) AS event_id, CAST(event_id * 53 % 1000 AS DOUBLE) AS tx, CAST(event_id * 17 % 1000 AS DOUBLE) AS ty FROM events GROUP BY 2, 3),
p AS (SELECT key, event_id, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM settlements JOIN t ON tx BETWEEN x - 50 AND x + 50 AND ty BETWEEN y - 50 AND y + 50),
b AS (SELECT key, event_id, d FROM p WHERE d <= 50 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, event_id) = 1) SELECT key, event_id AS near_event_id, round(d, 6) AS distance FROM settlements LEFT JOIN b USING (key)""")
def nearest_within(spark, sf_dir):
    n = spatial.nearest(settlements(spark, sf_dir).select("key", "x", "y"), tracks(spark, sf_dir), 50.0, "key", "event_id")
    return n.select("key", "near_event_id", F.round("distance", 6).alias("distance"))


@query("""SELECT c_custkey AS key, round(radians(3 + c_custkey % 90 / 10) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(4 + c_custkey % 70 / 10) / 2)) * 6378137, 3) AS my FROM customer""")
def mercator_project(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = G.mercator(3 + k % 90 / 10, 4 + k % 70 / 10)
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query("""SELECT n_nationkey AS key, round(abs((x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y0 - x0 * y2)) / 2, 6) AS area FROM
(SELECT n_nationkey, n_nationkey * 7.0 AS x0, n_nationkey * 3.0 AS y0, n_nationkey * 7.0 + 40 AS x1, n_nationkey * 2.0 AS y1, n_nationkey * 5.0 AS x2, n_nationkey * 3.0 + 60 AS y2 FROM nation)""")
def polygon_area(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(k * 7, k * 3), corner(k * 7 + 40, k * 2), corner(k * 5, k * 3 + 60))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.round(G.area(ring), 6).alias("area"))


@query(f"""WITH {_EXTENTS} SELECT extent, CAST(i AS BIGINT) AS grid_x, CAST(j AS BIGINT) AS grid_y, x0 + i * size AS left_x, y0 + j * size AS low_y FROM
(SELECT *, CASE WHEN extent % 2 = 0 THEN 50.0 ELSE 100.0 END AS size FROM extents), (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j) WHERE i * size < 150 AND j * size < 150""")
def regular_grid(spark, sf_dir):
    g = spatial.grid(extents(spark, sf_dir), "ring", F.when(F.col("extent") % 2 == 0, 50.0).otherwise(100.0))
    return g.select(
        "extent", F.col("grid_x").cast("long"), F.col("grid_y").cast("long"), F.col("grid_ring")[0]["x"].alias("left_x"), F.col("grid_ring")[0]["y"].alias("low_y")
    )


#: The area of a union of boxes: the plane cut at all of their edges, and the rectangles counted that some box of the code covers.
_UNION = """xs AS (SELECT code, v AS a, lead(v) OVER (PARTITION BY code ORDER BY v) AS b FROM (SELECT DISTINCT code, unnest([x0, x0 + side]) AS v FROM boxes)),
ys AS (SELECT code, v AS a, lead(v) OVER (PARTITION BY code ORDER BY v) AS b FROM (SELECT DISTINCT code, unnest([y0, y0 + side]) AS v FROM boxes)),
u AS (SELECT xs.code, sum((xs.b - xs.a) * (ys.b - ys.a)) AS area FROM xs JOIN ys ON xs.code = ys.code
  WHERE EXISTS (SELECT 1 FROM boxes q WHERE q.code = xs.code AND q.x0 <= xs.a AND q.x0 + side >= xs.b AND q.y0 <= ys.a AND q.y0 + side >= ys.b) GROUP BY 1)"""


@query(f"""WITH {_EXTENTS}, boxes AS (SELECT extent % 4 AS code, x0, y0, 150.0 AS side FROM extents), {_UNION}
SELECT code, count(*) AS pieces, round(any_value(u.area), 4) AS area FROM boxes JOIN u USING (code) GROUP BY 1""")
def dissolve(spark, sf_dir):
    d = overlay.dissolve(extents(spark, sf_dir).withColumn("code", F.col("extent") % 4), ["code"], "ring", 100.0)
    return d.select("code", F.col("n_parts").alias("pieces"), F.round("area", 4).alias("area"))


@query(f"""WITH {SETTLEMENTS}, boxes AS (SELECT nation AS code, x - 10 - key % 3 * 5 AS x0, y - 10 AS y0, 40.0 AS side FROM settlements), {_UNION}
SELECT code, count(*) AS n_parts, round(any_value(u.area), 4) AS area FROM boxes JOIN u USING (code) GROUP BY 1""")
def settled_area(spark, sf_dir):
    """The union of the squares around a nation's settlements, which overlap, touch and stand on one another."""
    s = settlements(spark, sf_dir)
    x0, y0 = F.col("x") - 10 - F.col("key") % 3 * 5, F.col("y") - 10
    d = overlay.dissolve(s.select(F.col("nation").alias("code"), G.box(x0, y0, x0 + 40, y0 + 40).alias("ring")), ["code"], "ring", 125.0)
    return d.select("code", "n_parts", F.round("area", 4).alias("area"))


@query(f"""WITH {_EXTENTS}, b AS (SELECT extent, x0 AS l, y0 AS b, x0 + 150 AS r, y0 + 150 AS t, x0 + 30 AS hl, y0 + 40 AS hb, x0 + 100 AS hr, y0 + 120 AS ht FROM extents),
p AS (SELECT n.s_suppkey AS supplier, CAST(n.s_suppkey * 71 % 900 AS DOUBLE) AS l, CAST(n.s_suppkey * 29 % 900 AS DOUBLE) AS b FROM supplier n),
q AS (SELECT supplier, l, b, l + 90 AS r, b + 80 AS t, l + 35 AS hl, b + 25 AS hb, l + 90 AS hr, b + 80 AS ht FROM p),
o AS (SELECT extent, supplier,
  greatest(0, least(b.r, q.r) - greatest(b.l, q.l)) * greatest(0, least(b.t, q.t) - greatest(b.b, q.b)) - greatest(0, least(b.hr, q.r) - greatest(b.hl, q.l)) * greatest(0, least(b.ht, q.t) - greatest(b.hb, q.b))
  - greatest(0, least(b.r, q.hr) - greatest(b.l, q.hl)) * greatest(0, least(b.t, q.ht) - greatest(b.b, q.hb)) + greatest(0, least(b.hr, q.hr) - greatest(b.hl, q.hl)) * greatest(0, least(b.ht, q.ht) - greatest(b.hb, q.hb)) AS area
  FROM b, q) SELECT extent, supplier, round(area, 4) AS area FROM o WHERE area > 1e-9""")
def overlay_of_frames(spark, sf_dir):
    """Extents with a hole against corner-shaped plots, neither of them convex."""
    x0, y0 = F.col("x0"), F.col("y0")
    frames = extents(spark, sf_dir).select("extent", F.array(G.box(x0, y0, x0 + 150, y0 + 150), G.box(x0 + 30, y0 + 40, x0 + 100, y0 + 120)).alias("rings"))
    k = F.col("s_suppkey")
    l, b = (k * 71 % 900).cast("double"), (k * 29 % 900).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    bend = F.array(corner(l, b), corner(l + 90, b), corner(l + 90, b + 25), corner(l + 35, b + 25), corner(l + 35, b + 80), corner(l, b + 80))
    plots = table(spark, sf_dir, "supplier").select(k.alias("supplier"), F.array(bend).alias("plot"))
    o = overlay.overlay(frames, plots, "rings", "plot", 60.0)
    return o.groupBy("extent", "supplier").agg(F.round(F.sum("piece_area"), 4).alias("area"))


@query(f"""WITH {_EXTENTS}, g AS (SELECT i * 120.0 AS gx, j * 120.0 AS gy, i * 10 + j AS cell FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j))
SELECT extent, CAST(cell AS BIGINT) AS cell, round((least(x0 + 150, gx + 120) - greatest(x0, gx)) * (least(y0 + 150, gy + 120) - greatest(y0, gy)), 4) AS piece_area FROM extents, g
WHERE least(x0 + 150, gx + 120) > greatest(x0, gx) AND least(y0 + 150, gy + 120) > greatest(y0, gy)""")
def clip_overlay_area(spark, sf_dir):
    cells = spark.range(81).select((F.floor(F.col("id") / 9) * 10 + F.col("id") % 9).alias("cell"), (F.floor(F.col("id") / 9) * 120.0).alias("gx"), (F.col("id") % 9 * 120.0).alias("gy"))
    gx, gy = F.col("gx"), F.col("gy")
    e = extents(spark, sf_dir).select("extent", F.array("ring").alias("rings"))
    o = overlay.overlay(e, cells.select("cell", F.array(G.box(gx, gy, gx + 120, gy + 120)).alias("cell_rings")), "rings", "cell_rings", 75.0)
    return o.groupBy("extent", "cell").agg(F.round(F.sum("piece_area"), 4).alias("piece_area"))


@query()
def voronoi_area(spark, sf_dir):
    """Cells of distinct settlement points; they sum to the envelope's area."""
    v = voronoi.voronoi_cells(settlements(spark, sf_dir).select("key", "x", "y"), "key", (0.0, 0.0, 1000.0, 1000.0))
    return v.select("key", F.round(G.area(F.col("ring")), 4).alias("area"))


@query()
def dispersion(spark, sf_dir):
    """Settlements pushed apart on a plane ten times as wide; some stand on one another."""
    s = settlements(spark, sf_dir).select("key", (10 * F.col("x")).alias("x"), (10 * F.col("y")).alias("y"))
    moved = tessellation.disperse(s, "key")
    return moved.select("key", F.round("x_new", 4).alias("x_new"), F.round("y_new", 4).alias("y_new"))


@query()
def moves_within_wards(spark, sf_dir):
    """Settlements that stand too near to another one, moved inside their ward of 2500 x 2500 m or to an extent, on a plane ten times as wide."""
    s = settlements(spark, sf_dir).select("key", (10 * F.col("x")).alias("x"), (10 * F.col("y")).alias("y"))
    near = spatial.neighbours(s, S.NEIGHBOUR_METRES, "key").select("key", "x", "y", (F.col("n_near") > 0).alias("too_near"))
    i, j = F.floor(F.col("id") / 4) * 2500.0, F.col("id") % 4 * 2500.0
    wards = spark.range(16).select(F.col("id").alias("ward"), G.box(i, j, i + 2500, j + 2500).alias("ward_ring"))
    x0, y0 = 10 * F.col("x0"), 10 * F.col("y0")
    e = extents(spark, sf_dir).select("extent", G.box(x0, y0, x0 + 150, y0 + 150).alias("extent_ring"))
    moved = relocation.move_within_wards(near, "key", wards, "ward", "ward_ring", e, "extent", "extent_ring")
    return moved.select("key", "too_near", F.round("x_new", 4).alias("x_new"), F.round("y_new", 4).alias("y_new"))


@query()
def target_area(spark, sf_dir):
    """Voronoi cells cut to the extents; circles where nothing is left."""
    e = extents(spark, sf_dir).withColumn("type", F.when(F.col("extent") % 3 == 0, "Built-up Area").otherwise("other"))
    a = tessellation.target_area(settlements(spark, sf_dir), e, "key", (0.0, 0.0, 1000.0, 1000.0), 80.0)
    area = F.aggregate("ring", F.lit(0.0), lambda s, r: s + G.area(r))
    return a.select("key", "type", F.round(area, 3).alias("area"))


#: The settlements of a state on a full lattice of 40 m, so that inner cells are boxes; wards of 130 m; extents of 90 m with a hole of 20 m, and lanes of 10 m.
_LATTICE = """n AS (SELECT key, state, nation, row_number() OVER (PARTITION BY state ORDER BY key) - 1 AS i, CAST(floor(sqrt(count(*) OVER (PARTITION BY state))) AS BIGINT) AS side
  FROM settlements WHERE key % 50 <> 7),
l AS (SELECT key, state, side, i % side AS i, i // side % side AS j, 10.0 + 40 * (i % side) AS x, 10.0 + 40 * (i // side % side) AS y FROM n),
b AS (SELECT *, floor(x / 130) * 130 AS wx, floor(y / 130) * 130 AS wy, floor(x / 100) * 100 AS ex, floor(y / 100) * 100 AS ey FROM l),
f AS (SELECT *, least(i, j) > 0 AND greatest(i, j) < side - 1 AND greatest(x, y) < 2600 AND x - ex < 90 AND y - ey < 90 AND NOT (x - ex >= 60 AND x - ex < 80 AND y - ey >= 60 AND y - ey < 80) AS held,
  greatest(0, least(x + 20, wx + 130, ex + 90) - greatest(x - 20, wx, ex)) * greatest(0, least(y + 20, wy + 130, ey + 90) - greatest(y - 20, wy, ey)) AS box_area,
  greatest(0, least(x + 20, wx + 130, ex + 80) - greatest(x - 20, wx, ex + 60)) * greatest(0, least(y + 20, wy + 130, ey + 80) - greatest(y - 20, wy, ey + 60)) AS hole FROM b)"""


def lattice(spark, sf_dir):
    """(key, state, x, y, region): settlements on a lattice of their state; some without coordinates. States lie 100 km apart, so that none reaches another one's wards."""
    s = settlements(spark, sf_dir)
    s = s.join(F.broadcast(table(spark, sf_dir, "region")), F.col("state") == F.col("r_name")).select("key", "state", F.col("r_regionkey").alias("region"))
    w = Window.partitionBy("state")
    n = s.where("key % 50 <> 7").withColumns({"i": F.row_number().over(w.orderBy("key")) - 1, "side": F.floor(F.sqrt(F.count("*").over(w))).cast("long")})
    i, j = F.expr("i % side"), F.expr("i div side % side")
    on = n.select("key", "state", (10.0 + 40 * i + 100_000 * F.col("region")).alias("x"), (10.0 + 40 * j).alias("y"))
    return on.unionByName(s.where("key % 50 = 7").select("key", "state"), allowMissingColumns=True)


def lattice_frames(spark, sf_dir, count: int, width: float):
    """``count`` x ``count`` places of ``width`` in each state: state, i, j, x, y."""
    cells = table(spark, sf_dir, "region").select(F.col("r_name").alias("state"), "r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(count * count - 1))).alias("n"))
    i, j = F.floor(F.col("n") / count), F.col("n") % count
    return cells.select("state", i.alias("i"), j.alias("j"), (i * width + 100_000.0 * F.col("r_regionkey")).alias("x"), (j * width).alias("y"))


def lattice_areas(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    wards = lattice_frames(spark, sf_dir, 20, 130.0)
    wards = wards.select("state", F.col("i").cast("string").alias("lga"), F.col("j").cast("string").alias("ward"), G.box(x, y, x + 130, y + 130).alias("ring"))
    e = lattice_frames(spark, sf_dir, 26, 100.0)
    kind = F.when((F.col("i") + F.col("j")) % 2 == 0, "Built-up Area").otherwise("other")
    e = e.select(F.array(G.box(x, y, x + 90, y + 90), G.box(x + 60, y + 60, x + 80, y + 80)).alias("rings"), kind.alias("type"))
    return areas.target_areas(lattice(spark, sf_dir), wards, e, "key", 500.0)


@query(f"""WITH {SETTLEMENTS}, {_LATTICE} SELECT key, state, CASE WHEN held THEN 'cell' ELSE 'circle' END AS origin,
  CASE WHEN NOT held THEN NULL WHEN (ex + ey) % 200 = 0 THEN 'Built-up Area' ELSE 'other' END AS type, round(CASE WHEN held THEN box_area - hole ELSE 320000 * sin(pi() / 32) END, 3) AS area FROM f
UNION ALL SELECT key, state, 'none', NULL, NULL FROM settlements WHERE key % 50 = 7""")
def target_area_chain(spark, sf_dir):
    """Settlements, their cells, own wards and extents: every settlement once."""
    return lattice_areas(spark, sf_dir).select("key", "state", "origin", "type", F.round("area", 3).alias("area"))


@query()
def target_area_grid(spark, sf_dir):
    """The cells of the chain's areas with the tracks in them as buildings."""
    t = tracks(spark, sf_dir).select(F.col("x"), F.col("y"))
    g = areas.gridded_target_areas(lattice_areas(spark, sf_dir), t, "key")
    return g.withColumn("area", F.round("area", 4))


@query(f"""WITH {TRACKS}, {_EXTENTS}, e AS (SELECT *, CASE WHEN extent % 3 = 0 THEN 50.0 ELSE 100.0 END AS s FROM extents),
c AS (SELECT extent, i AS grid_x, j AS grid_y, x0 + i * s AS l, y0 + j * s AS b, least(x0 + 150, x0 + (i + 1) * s) AS r, least(y0 + 150, y0 + (j + 1) * s) AS t FROM e, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j) WHERE i * s < 150 AND j * s < 150),
p AS (SELECT x, y, count(*) AS n FROM tracks GROUP BY 1, 2),
n AS (SELECT extent, grid_x, grid_y, (r - l) * (t - b) AS area, coalesce((SELECT sum(n) FROM p WHERE x >= l AND x < r AND y >= b AND y < t), 0) AS buildings FROM c)
SELECT extent, CAST(grid_x AS BIGINT) AS grid_x, CAST(grid_y AS BIGINT) AS grid_y, round(area, 4) AS area, CAST(buildings AS BIGINT) AS buildings FROM n WHERE area > 30 QUALIFY buildings > 2 OR bool_and(buildings <= 2) OVER (PARTITION BY extent)""")
def gridded_target_area(spark, sf_dir):
    """Cells of the extents with building counts, reviewed."""
    e = extents(spark, sf_dir).withColumn("type", F.when(F.col("extent") % 3 == 0, "Built-up Area").otherwise("other"))
    g = tessellation.gridded_area(e, "extent", "ring", "type", tracks(spark, sf_dir).select("x", "y"))
    return g.select("extent", "grid_x", "grid_y", F.round("area", 4).alias("area"), "buildings")


_KRUEGER = """WITH c AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n), k AS (SELECT n, 2 * sqrt(n) / (1 + n) AS q, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS a,
  n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM c),
p AS (SELECT c_custkey AS key, sin(radians(4 + c_custkey % 70 / 10)) AS s, radians(3 + c_custkey % 90 / 10 - 3) AS lam FROM customer),
t AS (SELECT *, sinh(atanh(s) - q * atanh(q * s)) AS t FROM p, k), e AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT key, round(500000 + 0.9996 * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS ux,
  round(0.9996 * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS uy FROM e"""


@query(_KRUEGER)
def utm_project(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = G.utm(3 + k % 90 / 10, 4 + k % 70 / 10, 31)
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.round(x, 3).alias("ux"), F.round(y, 3).alias("uy"))
