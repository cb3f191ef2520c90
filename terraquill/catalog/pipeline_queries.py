"""Whole pipelines on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.catalog.base import PLANS, SETTLEMENTS, plans, query, settlements, table, tracks
from terraquill.catalog.spatial_queries import _EXTENTS, _INSIDE, extents
from terraquill.functions import geometry as G
from terraquill.operators import matching as M
from terraquill.plans import listing, tracking

_CELLS = """cells AS (SELECT key, key || '_' || q AS cell, x - x % 50 + CASE WHEN q % 2 = 1 THEN 25 ELSE 0 END AS cx, y - y % 50 + CASE WHEN q >= 2 THEN 25 ELSE 0 END AS cy, CASE WHEN key % 9 = 0 AND q = 1 THEN 'Visited' END AS visitation
  FROM settlements, (SELECT unnest(range(4)) AS q))"""
_POINTS = "points AS (SELECT CAST(event_id * 53 % 1000 AS DOUBLE) AS px, CAST(event_id * 17 % 1000 AS DOUBLE) AS py FROM events WHERE value / 50 < 1 AND hour(ts) BETWEEN 7 AND 16)"


def _cells(spark, sf_dir):
    s = settlements(spark, sf_dir).select("key", "x", "y", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("q"))
    x0 = F.col("x") - F.col("x") % 50 + F.when(F.col("q") % 2 == 1, 25).otherwise(0)
    y0 = F.col("y") - F.col("y") % 50 + F.when(F.col("q") >= 2, 25).otherwise(0)
    return s.select(
        "key", F.concat_ws("_", "key", "q").alias("cell"), G.box(x0, y0, x0 + 25, y0 + 25).alias("ring"),
        F.when((F.col("key") % 9 == 0) & (F.col("q") == 1), S.VISITED).alias("visitation"),
    )


@query(f"""WITH {SETTLEMENTS}, {_CELLS}, {_POINTS}, grid AS (SELECT px, py FROM points GROUP BY 1, 2),
hit AS (SELECT cell FROM cells JOIN grid ON px >= cx AND px < cx + 25 AND py >= cy AND py < cy + 25 GROUP BY 1),
m AS (SELECT key, count(*) FILTER (visitation = 'Visited' OR cell IN (SELECT cell FROM hit)) AS visited, count(*) AS total FROM cells GROUP BY key),
t AS (SELECT key, count(*) AS track_count FROM settlements JOIN points ON px >= x - 20 AND px < x + 20 AND py >= y - 20 AND py < y + 20 GROUP BY key),
s AS (SELECT key, m.visited / total AS coverage, m.visited > 0 AS v, coalesce(track_count, 0) AS track_count, CASE WHEN key % 5 = 0 THEN 'Visited' END AS prev,
  CASE WHEN key % 3 <> 0 THEN 'Yes' END AS planned, CASE WHEN key % 4 = 0 THEN 0.6 END AS prev_coverage FROM settlements LEFT JOIN m USING (key) LEFT JOIN t USING (key)),
u AS (SELECT *, CASE WHEN v OR prev = 'Visited' THEN 'Visited' ELSE 'Not Visited' END AS cum, greatest(coverage, prev_coverage) AS final FROM s)
SELECT key, CASE WHEN planned IS NOT NULL THEN cum END AS day_2, cum AS day_2_cumm, round(final, 6) AS final_coverage, track_count,
  CASE WHEN final IS NULL OR final = 0 THEN 'No Coverage' WHEN round_even(final, 2) < 0.5 THEN 'Poorly Covered' WHEN round_even(final, 2) < 0.7 THEN 'Partially Covered' ELSE 'Fully Covered' END AS settlement_coverage,
  CASE WHEN track_count = 0 THEN NULL WHEN track_count BETWEEN 1 AND 12 THEN '<12 mins' WHEN track_count BETWEEN 13 AND 30 THEN '12 - 30 mins' WHEN track_count BETWEEN 31 AND 60 THEN '30 mins - 1 hr' WHEN track_count BETWEEN 61 AND 120 THEN '1 - 2 hrs' ELSE '>2 hrs' END AS time_spent FROM u""")
def gridded_tracking(spark, sf_dir):
    """The flagship: coverage of planned settlements on the mop-up day, from cells, extents and tracks."""
    k = F.col("key")
    plan = settlements(spark, sf_dir).select(
        "key", F.when(k % 5 == 0, S.VISITED).alias("day_1_cumm"), F.when(k % 3 != 0, "Yes").alias("day_2"), F.when(k % 4 == 0, 0.6).alias("prev_coverage")
    )
    x, y = F.col("x"), F.col("y")
    around = settlements(spark, sf_dir).select("key", G.box(x - 20, y - 20, x + 20, y + 20).alias("ring"))
    t = tracking.valid_tracks(tracks(spark, sf_dir).withColumn("speed", F.col("value") / 50))
    out = tracking.gridded_tracking(plan, _cells(spark, sf_dir), around, t, "key", tracking.Day(2, mop_up=True))
    return out.select("key", "day_2", "day_2_cumm", F.round("final_coverage", 6).alias("final_coverage"), "track_count", "settlement_coverage", "time_spent")


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT DISTINCT CAST(event_id * 53 % 1000 AS DOUBLE) AS px, CAST(event_id * 17 % 1000 AS DOUBLE) AS py FROM events WHERE value / 50 < 1 AND hour(ts) BETWEEN 7 AND 16)
SELECT key, CASE WHEN EXISTS (SELECT 1 FROM t WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 12) THEN 'Visited' ELSE 'Not Yet Visited' END AS visitation FROM settlements""")
def buffer_tracking(spark, sf_dir):
    t = tracking.valid_tracks(tracks(spark, sf_dir).withColumn("speed", F.col("value") / 50))
    return tracking.buffer_tracking(settlements(spark, sf_dir), t, "key", "event_id", tracking.Day(1), 12.0).select("key", "visitation")


@query(f"""WITH {SETTLEMENTS}, {PLANS}, t AS (SELECT DISTINCT CAST(event_id * 53 % 1000 AS DOUBLE) AS px, CAST(event_id * 17 % 1000 AS DOUBLE) AS py FROM events WHERE event_type = 'click'),
h AS (SELECT key, EXISTS (SELECT 1 FROM plans p WHERE p.key = s.key AND round = 1996 AND status = 'Visited') AS a, EXISTS (SELECT 1 FROM plans p WHERE p.key = s.key AND round = 1997 AND status = 'Visited') AS b,
  EXISTS (SELECT 1 FROM t WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 12) AS c FROM settlements s)
SELECT key, nullif(concat_ws(' | ', CASE WHEN a THEN 'form' END, CASE WHEN b THEN 'survey' END, CASE WHEN c THEN 'GTS' END), '') AS sources, CAST(a::INTEGER + b::INTEGER + c::INTEGER AS BIGINT) AS reach,
  CASE WHEN a OR b OR c THEN 'Visited' ELSE 'Not Visited' END AS status FROM h""")
def triangulation(spark, sf_dir):
    p = plans(spark, sf_dir).where("status = 'Visited'").select("plan", "key", "round")
    sources = {
        "form": p.where("round = 1996").drop("round"), "survey": p.where("round = 1997").drop("round"),
        "GTS": tracks(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("plan"), "x", "y"),
    }
    out = tracking.triangulate(settlements(spark, sf_dir), sources, "key", "plan", 12.0)
    return out.select("key", "sources", F.col("reach").cast("long").alias("reach"), "status")


_ROUND = """r{0} AS (SELECT key, min_by(status, (status, coverage)) AS visit, min_by(coverage, (status, coverage)) AS coverage FROM (SELECT key, CASE WHEN status = 'Visited' THEN 'Visited' ELSE 'Not Visited' END AS status,
  CASE plan % 3 WHEN 0 THEN 'Fully Covered' WHEN 1 THEN 'Poorly Covered' ELSE 'No Coverage' END AS coverage FROM plans WHERE round = {0}) GROUP BY key)"""


@query(f"""WITH {SETTLEMENTS}, {PLANS}, {", ".join(_ROUND.format(y) for y in (1995, 1996, 1997))},
j AS (SELECT s.key, coalesce(a.visit, 'Not Found') AS v1, coalesce(b.visit, 'Not Found') AS v2, coalesce(c.visit, 'Not Found') AS v3, [coalesce(a.coverage, 'Not Found'), coalesce(b.coverage, 'Not Found'), coalesce(c.coverage, 'Not Found')] AS cov
  FROM settlements s LEFT JOIN r1995 a ON s.key = a.key LEFT JOIN r1996 b ON s.key = b.key LEFT JOIN r1997 c ON s.key = c.key),
n AS (SELECT *, (v1 = 'Visited')::INTEGER + (v2 = 'Visited')::INTEGER + (v3 = 'Visited')::INTEGER AS seen, (v1 <> 'Not Found')::INTEGER + (v2 <> 'Not Found')::INTEGER + (v3 <> 'Not Found')::INTEGER AS known FROM j)
SELECT key, v1 AS r1995_visit, v2 AS r1996_visit, v3 AS r1997_visit, CAST(seen AS BIGINT) AS contact, CASE WHEN known > 0 THEN round_even(seen / known, 2) ELSE 0 END AS contact_proportion,
  (SELECT first(x ORDER BY k DESC, i) FROM (SELECT x, count(*) AS k, min(i) AS i FROM (SELECT unnest(cov) AS x, unnest(range(3)) AS i) WHERE x <> 'Not Found' GROUP BY x)) AS coverage FROM n""")
def contact_analysis(spark, sf_dir):
    p = plans(spark, sf_dir)
    k = F.col("plan") % 3
    p = p.select(
        "round", "key", F.when(F.col("status") == S.VISITED, S.VISITED).otherwise(S.NOT_VISITED).alias("visitation"),
        F.when(k == 0, S.FULL).when(k == 1, S.POOR).otherwise(S.NO_COVERAGE).alias("coverage"),
    )
    rounds = {f"r{y}": p.where(F.col("round") == y).drop("round") for y in (1995, 1996, 1997)}
    out = tracking.contact_analysis(settlements(spark, sf_dir).select("key"), rounds, ["key"], "key")
    return out.select("key", *(f"{r}_visit" for r in rounds), F.col("contact").cast("long").alias("contact"), "contact_proportion", "coverage")


_LIST = """list AS (SELECT key, CASE WHEN key % 50 = 0 THEN 'ab' ELSE settlement END AS settlement, CASE WHEN key % 13 = 0 THEN NULL ELSE x END AS x, y, key % 1450 AS unique_code,
  CASE WHEN key % 21 = 0 THEN 'does not exist' END AS comment, CASE WHEN key % 2 = 0 THEN 'Y' ELSE 'N' END AS urban, CASE WHEN key % 6 < 3 THEN 'Y' ELSE 'N' END AS rural, CASE WHEN key % 7 < 3 THEN 'Y' ELSE 'N' END AS scattered FROM settlements)"""


@query(f"""WITH {SETTLEMENTS}, {_LIST}, live AS (SELECT * FROM list WHERE comment IS NULL),
near AS (SELECT a.key, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM live a JOIN live b ON a.key <> b.key AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60 GROUP BY 1),
f AS (SELECT l.key, CASE WHEN length(settlement) < 3 THEN 'invalid name length' END AS invalid_name_length, CASE WHEN x IS NOT NULL AND count(*) OVER (PARTITION BY x, y) > 1 THEN 'stacked_point' END AS stacked_point,
  CASE WHEN count(*) OVER (PARTITION BY unique_code) > 1 THEN 'duplicate_attribute' END AS duplicate_attribute, CASE WHEN x IS NULL THEN 'No Coordinates' END AS no_coordinates,
  CASE WHEN d <= 20 THEN 'Within 10m' WHEN d IS NOT NULL THEN 'Within 30m' END AS proximity_issues,
  CASE WHEN urban = rural AND rural = scattered THEN 'urban, rural and scattered cannot have the same ' || rural || ' value' WHEN urban = 'Y' AND scattered = 'Y' THEN 'urban and scattered cannot be both be Y' END AS st FROM live l LEFT JOIN near n ON l.key = n.key),
g AS (SELECT *, CASE WHEN coalesce(invalid_name_length, stacked_point, duplicate_attribute, no_coordinates, proximity_issues, st) IS NOT NULL THEN 'Flagged' END AS is_flagged FROM f)
SELECT key, is_flagged, CASE WHEN is_flagged IS NULL THEN NULL WHEN coalesce(stacked_point, duplicate_attribute, proximity_issues, st) IS NOT NULL THEN 'Major Flag' ELSE 'Minor Flag' END AS flag_level,
  nullif(concat_ws(', ', invalid_name_length, stacked_point, duplicate_attribute, no_coordinates, proximity_issues), '') AS gis_feedback,
  CASE WHEN is_flagged IS NULL THEN 'Validated' WHEN no_coordinates IS NOT NULL THEN 'Not Validated' ELSE 'Validation Ongoing' END AS validation_status FROM g
UNION ALL SELECT key, NULL, NULL, NULL, 'Validated Unknown' FROM list WHERE comment IS NOT NULL""")
def settlement_qc(spark, sf_dir):
    k = F.col("key")
    yn = lambda c: F.when(c, "Y").otherwise("N")
    s = settlements(spark, sf_dir).select(
        "key", F.when(k % 50 == 0, "ab").otherwise(F.col("settlement")).alias("settlement"), F.when(k % 13 != 0, F.col("x")).alias("x"), "y", (k % 1450).alias("unique_code"),
        F.when(k % 21 == 0, "does not exist").alias("comment"), yn(k % 2 == 0).alias("urban"), yn(k % 6 < 3).alias("rural"), yn(k % 7 < 3).alias("scattered"),
    )
    return listing.settlement_qc(s, "key").select("key", "is_flagged", "flag_level", "gis_feedback", "validation_status")


@query(f"""WITH {SETTLEMENTS}, {_EXTENTS}, e AS (SELECT extents.*, 'nation_' || extent AS lga FROM extents), j AS (SELECT t.key, min(e.lga) AS lga FROM settlements t JOIN e ON {_INSIDE} GROUP BY 1)
SELECT key, CASE WHEN coalesce(round(100 * (1 - levenshtein(lower(s.lga), j.lga) / greatest(length(s.lga), length(j.lga))), 6) >= 89, false) THEN 'pass' ELSE 'fail' END AS lga_review FROM settlements s LEFT JOIN j USING (key)""")
def submission_review(spark, sf_dir):
    b = extents(spark, sf_dir).withColumn("lga", F.concat(F.lit("nation_"), F.col("extent")))
    return listing.review_submissions(settlements(spark, sf_dir).select("key", "lga", "x", "y"), b, "key", ["lga"], M.LEVENSHTEIN, 89).select("key", "lga_review")


@query(f"""WITH {PLANS}, t AS (SELECT key % 12 AS ward, days, unnest(string_split(teams, '/')) AS code FROM plans), p AS (SELECT ward, lpad(code, 3, '0') AS team, days FROM t),
e AS (SELECT ward, team, d FROM p LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(days, '\\d')) AS d) ON true), s AS (SELECT ward, team, list_sort(list_distinct(list(d) FILTER (d IS NOT NULL))) AS l FROM e GROUP BY 1, 2)
SELECT ward, team, coalesce(array_to_string(l, ','), '') AS days, array_to_string(list_filter(['1', '2', '3', '4'], lambda x: NOT coalesce(list_contains(l, x), false)), ',') AS missing_days FROM s""")
def plan_validation_teams(spark, sf_dir):
    p = plans(spark, sf_dir).select((F.col("key") % 12).alias("ward"), F.col("teams").alias("team"), "days")
    allocation = spark.range(12).select(F.col("id").alias("ward"), F.lit(20).alias("expected"), F.lit(1).alias("low"), F.lit(25).alias("high"))
    return listing.validate_plan(p, allocation, ["ward"])["teams"]


@query(f"""WITH {PLANS}, t AS (SELECT plan, key % 12 AS ward, unnest(string_split(teams, '/')) AS code FROM plans) SELECT plan, ward, lpad(code, 3, '0') AS team FROM t WHERE NOT CAST(code AS INTEGER) BETWEEN 1 AND 25""")
def plan_out_of_range(spark, sf_dir):
    p = plans(spark, sf_dir).select("plan", (F.col("key") % 12).alias("ward"), F.col("teams").alias("team"), "days")
    allocation = spark.range(12).select(F.col("id").alias("ward"), F.lit(20).alias("expected"), F.lit(1).alias("low"), F.lit(25).alias("high"))
    return listing.validate_plan(p, allocation, ["ward"])["out_of_range"].select("plan", "ward", "team")


@query("""SELECT s_suppkey, 'W' || s_nationkey || chr(CAST(65 + (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 26 AS INTEGER)) AS take_off_code FROM supplier""")
def take_off_codes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ward"))
    wards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ward"), F.concat(F.lit("W"), "n_nationkey").alias("ward_code"))
    return listing.take_off_codes(s, wards, "ward", "ward_code", [F.col("s_suppkey")]).select("s_suppkey", "take_off_code")


@query(f"""WITH {SETTLEMENTS}, {PLANS} SELECT state, count(*) FILTER (status = 'Visited') AS visited, count(*) FILTER (status = 'Not Visited') AS not_visited, count(*) FILTER (status IN ('Visited', 'Not Visited')) AS total FROM plans JOIN settlements USING (key) GROUP BY 1
UNION ALL SELECT 'Total', count(*) FILTER (status = 'Visited'), count(*) FILTER (status = 'Not Visited'), count(*) FILTER (status IN ('Visited', 'Not Visited')) FROM plans JOIN settlements USING (key)""")
def post_report(spark, sf_dir):
    p = plans(spark, sf_dir).join(settlements(spark, sf_dir).select("key", "state"), "key")
    return listing.post_report(p, ["state"], "status", (S.VISITED, S.NOT_VISITED))
