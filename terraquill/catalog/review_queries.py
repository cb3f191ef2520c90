"""Reviews: boundaries, global ids, scores, filters, notes and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill.catalog.base import PLANS, SETTLEMENTS, plans, query, settlements, table, tracks
from terraquill.catalog.spatial_queries import _EXTENTS, _INSIDE, extents
from terraquill.functions import fuzzy
from terraquill.functions import text as T
from terraquill.operators import review
from terraquill.plans import checkout, listing

#: Extents with the names of a settlement of their nation, so that points lie inside and outside the right one. Of every four wards, one is written with its words
#: the other way round, one with a word more, and one with another letter, whose score of 90 to 96 is below the cutoff.
_NAMED = f"""{_EXTENTS}, b AS (SELECT x0, y0, r_name AS state, CASE WHEN extent % 11 <> 0 THEN n_name END AS lga, n_name || CASE WHEN extent % 4 <> 3 THEN '_MACHINERY' ELSE '' END AS base,
  CASE extent % 4 WHEN 1 THEN 'MACHINERY ' || n_name WHEN 2 THEN n_name || '_MACHINERY AREA' WHEN 3 THEN n_name || '_MACHINERX' ELSE n_name || '_MACHINERY' END AS ward FROM extents JOIN nation ON extent = n_nationkey JOIN region ON n_regionkey = r_regionkey),
own AS (SELECT key, CASE WHEN key % 7 <> 0 THEN state END AS state, lower(lga) AS lga, CASE WHEN key % 5 <> 0 THEN ward END AS ward, CASE WHEN key % 13 <> 0 THEN x END AS x, y FROM settlements),
j AS (SELECT t.key, min(struct_pack(s := b.state, l := b.lga, w := b.ward, base := b.base)) AS f FROM own t JOIN b ON {_INSIDE} GROUP BY 1), o AS (SELECT own.*, f.s AS bs, f.l AS bl, f.w AS bw, f.base AS base FROM own LEFT JOIN j USING (key))"""


def _named(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    e = extents(spark, sf_dir).join(n, F.col("extent") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    lga = F.when(F.col("extent") % 11 != 0, F.col("n_name"))
    end = lambda text: F.concat("n_name", F.lit(text))
    k = F.col("extent") % 4
    ward = F.when(k == 1, F.concat(F.lit("MACHINERY "), "n_name")).when(k == 2, end("_MACHINERY AREA")).when(k == 3, end("_MACHINERX")).otherwise(end("_MACHINERY"))
    return e.select("ring", F.col("r_name").alias("state"), lga.alias("lga"), ward.alias("ward"))


def _own(spark, sf_dir):
    k = F.col("key")
    return settlements(spark, sf_dir).select(
        "key", F.when(k % 7 != 0, F.col("state")).alias("state"), F.lower("lga").alias("lga"), F.when(k % 5 != 0, F.col("ward")).alias("ward"), F.when(k % 13 != 0, F.col("x")).alias("x"), "y"
    )


@query(f"""WITH {SETTLEMENTS}, {_NAMED} SELECT key, CASE WHEN bs IS NULL AND (x IS NULL OR y IS NULL) THEN NULL WHEN bs IS NULL OR state IS NULL OR lower(state) <> lower(bs) THEN 'Outside State'
  WHEN lga IS NULL OR bl IS NULL OR lower(lga) <> lower(bl) THEN 'Outside LGA' WHEN ward IS NULL OR base IS NULL OR lower(ward) <> lower(base) THEN 'Outside Ward' END AS boundary_issues FROM o""")
def boundary_review(spark, sf_dir):
    """State by partial ratio, LGA and ward by token set ratio: words swapped or added pass, another letter doesn't."""
    return listing.boundary_flags(_own(spark, sf_dir), _named(spark, sf_dir), "key", ["state", "lga", "ward"]).select("key", "boundary_issues")


@query(f"""WITH {SETTLEMENTS}, {_NAMED} SELECT key, CASE WHEN bs IS NULL AND (x IS NULL OR y IS NULL) THEN NULL WHEN state IS NULL THEN NULL WHEN bs IS NULL OR lower(state) <> lower(bs) THEN 'Outside State'
  WHEN lga IS NULL THEN NULL WHEN bl IS NULL OR lower(lga) <> lower(bl) THEN 'Outside LGA' WHEN ward IS NULL THEN NULL WHEN bw IS NULL OR lower(ward) <> lower(bw) THEN 'Outside Ward' END AS boundary_issues FROM o""")
def boundary_review_exact(spark, sf_dir):
    return listing.boundary_flags(_own(spark, sf_dir), _named(spark, sf_dir), "key", ["state", "lga", "ward"], exact=True).select("key", "boundary_issues")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 9 = 0 THEN 'No UUID' WHEN count(*) OVER (PARTITION BY CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE md5(CAST(o_orderkey // 3 * (o_orderkey % 2) + o_orderkey * (1 - o_orderkey % 2) AS VARCHAR)) END) > 1 THEN 'Duplicate UUID' END AS issue FROM orders""")
def global_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = (F.floor(k / 3) * (k % 2) + k * (1 - k % 2)).cast("string")
    o = table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 9 != 0, F.md5(raw.cast("binary"))).alias("eha_guid"))
    return listing.global_id_flag(o).select("key", F.col("WE_eha_guid").alias("issue"))


@query()
def fuzzy_scores(spark, sf_dir):
    """All scores of each part's name with that of the next part."""
    p = table(spark, sf_dir, "part")
    pairs = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("key"), F.col("p_name").alias("b")), "key")
    names = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio")
    return pairs.select("key", "a", "b", *(fuzzy.score(n, F.col("a"), F.col("b")).cast("int").alias(n) for n in names), F.round(fuzzy.levenshtein_score(F.col("a"), F.col("b")), 6).alias("levenshtein"))


@query(f"""WITH {SETTLEMENTS} SELECT key, lga, CASE WHEN balance < -995 THEN 'Major Flag' WHEN balance < 0 THEN 'Minor Flag' END AS flag_level, NOT bool_or(balance < -995) OVER (PARTITION BY lga) AS passed FROM settlements""")
def checkout_gate(spark, sf_dir):
    """Settlements of nations without a major flag pass, all others are held back."""
    level = F.when(F.col("balance") < -995, "Major Flag").when(F.col("balance") < 0, "Minor Flag")
    passed, held = checkout.gate(settlements(spark, sf_dir).select("key", "lga", level.alias("flag_level")), "lga")
    return passed.withColumn("passed", F.lit(True)).unionByName(held.withColumn("passed", F.lit(False)))


@query(f"""WITH {PLANS}, m AS (SELECT plan, CASE WHEN key % 5 = 0 THEN 'Missing ' || (plan % 4 + 1) || ' Teams' END AS msg, key % 30 AS ward FROM plans) SELECT ward, count(*) AS wards, CAST(sum(plan % 4 + 1) AS BIGINT) AS teams FROM m WHERE msg IS NOT NULL GROUP BY ward""")
def shortfall_by_ward(spark, sf_dir):
    k = F.col("key")
    p = plans(spark, sf_dir).select((k % 30).alias("ward"), F.when(k % 5 == 0, F.concat(F.lit("Missing "), F.col("plan") % 4 + 1, F.lit(" Teams"))).alias("msg"))
    return review.shortfall(p, ["ward"], "msg")


@query(f"""WITH {PLANS}, m AS (SELECT unnest(list_distinct(regexp_extract_all(days, '\\d'))) AS d FROM plans) SELECT t.d AS day, count(m.d) AS n FROM (VALUES ('1'), ('2'), ('3'), ('4')) AS t(d) LEFT JOIN m ON t.d = m.d GROUP BY 1""")
def missing_day_histogram(spark, sf_dir):
    listed = F.array_join(F.regexp_extract_all("days", F.lit(r"(\d)"), F.lit(1)), ", ")
    return review.missing_day_histogram(plans(spark, sf_dir).select(listed.alias("missing")), "missing")


@query(f"""WITH {SETTLEMENTS}, {PLANS}, p AS (SELECT key, count(*) AS n FROM plans WHERE round = 1996 GROUP BY key)
SELECT (SELECT count(*) FROM settlements) AS raw_rows, (SELECT count(*) FROM p) AS carried, (SELECT count(*) FROM p WHERE n > 1) AS split, greatest((SELECT count(*) FROM settlements) - (SELECT count(*) FROM p), 0) AS dropped""")
def carried_settlements(spark, sf_dir):
    return review.carried_settlements(settlements(spark, sf_dir), plans(spark, sf_dir).where("round = 1996"), "key")


@query(f"""WITH {PLANS} SELECT 'days' AS review, count(days) AS "rows", count(DISTINCT days) AS issues FROM plans UNION ALL SELECT 'teams', count(teams), count(DISTINCT teams) FROM plans""")
def issue_counts(spark, sf_dir):
    p = plans(spark, sf_dir)
    return review.issue_counts({"days": (p, "days"), "teams": (p, "teams")})


@query(f"""WITH {SETTLEMENTS}, {PLANS} SELECT (SELECT count(*) FROM settlements) AS total_cells, (SELECT count(*) FROM plans) AS total_grids, (SELECT count(DISTINCT key) FROM settlements) AS unique_cells, (SELECT count(DISTINCT key) FROM plans) AS unique_grids,
  (SELECT count(DISTINCT key) FROM settlements) = (SELECT count(DISTINCT key) FROM plans) AS is_consistent""")
def layer_consistency(spark, sf_dir):
    return review.layer_consistency(settlements(spark, sf_dir).select("key"), plans(spark, sf_dir).select("key"), "key")


@query(f"""WITH {PLANS}, p AS (SELECT CASE WHEN plan % 6 = 0 THEN ' ' ELSE teams END AS team, days, key % 40 AS lga FROM plans) SELECT count(*) AS total_rows, count(*) FILTER (coalesce(trim(team), '') = '' AND days IS NULL) AS missing_both, count(DISTINCT lga) AS lgas FROM p""")
def ingest_note(spark, sf_dir):
    p = plans(spark, sf_dir).select(F.when(F.col("plan") % 6 == 0, " ").otherwise(F.col("teams")).alias("team"), "days", (F.col("key") % 40).alias("lga"))
    return review.ingest_note(p, "lga", "team", "days")


@query(f"""WITH {SETTLEMENTS} SELECT count(*) AS total_rows, count(*) FILTER (key % 7 = 0 OR key % 10 = 0) AS missing FROM settlements""")
def missing_admin(spark, sf_dir):
    k = F.col("key")
    s = settlements(spark, sf_dir).select(F.when(k % 7 != 0, F.col("lga")).alias("lga"), F.when(k % 10 == 0, "  ").otherwise(F.col("ward")).alias("ward"))
    return review.missing_admin(s, "lga", "ward", wards=True)


@query(f"""SELECT (SELECT count(*) FROM events) AS original, (SELECT count(*) FROM events WHERE value / 50 < 1 AND hour(ts) BETWEEN 7 AND 16) AS returned, (SELECT count(*) FROM events WHERE NOT (value / 50 < 1 AND hour(ts) BETWEEN 7 AND 16)) AS dropped""")
def dropped_tracks(spark, sf_dir):
    from terraquill.plans.tracking import valid_tracks

    t = tracks(spark, sf_dir)
    return review.dropped_rows(t, valid_tracks(t.withColumn("speed", F.col("value") / 50)))


@query(f"""WITH {SETTLEMENTS} SELECT key, y / 4 - 120 AS lat, x / 2 - 300 AS lon, CASE key % 4 WHEN 0 THEN 'Visited' WHEN 1 THEN 'Not Yet Visited' ELSE 'Unknown' END AS status, CASE WHEN key % 3 = 0 THEN 'Fully Covered' END AS coverage FROM settlements
WHERE state = 'EUROPE' AND y / 4 - 120 BETWEEN -90 AND 90 AND x / 2 - 300 BETWEEN -180 AND 180 AND NOT (y / 4 = 120 AND x / 2 = 300)""")
def map_points(spark, sf_dir):
    k = F.col("key")
    s = review.in_scope(settlements(spark, sf_dir), state=" Europe", ward=None).select(
        "key", (F.col("y") / 4 - 120).cast("string").alias("lat"), (F.col("x") / 2 - 300).alias("lon"),
        F.when(k % 4 == 0, " visited ").when(k % 4 == 1, "NOT YET VISITED").otherwise("?").alias("status"), F.when(k % 3 == 0, "fully covered").otherwise("none").alias("coverage"),
    )
    return review.map_points(s, "lat", "lon", "status", "coverage")


@query("""SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN '1_2' WHEN 1 THEN '2_3_4' WHEN 2 THEN '4' END AS days FROM part""")
def preset_standardize(spark, sf_dir):
    """Exact values stay; ``day 2_3_4`` and ``4.`` become the preset that they hold."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "1_2").when(k % 4 == 1, "day 2_3_4").when(k % 4 == 2, "4.")
    return review.preset_values(table(spark, sf_dir, "part").select(k.alias("key"), raw.alias("days")), "days", ("2_3_4", "1_2", "4"))


@query("""SELECT o_orderkey AS key, o_custkey % 3 AS delimiters, o_orderkey * 7 > 10000 AS over_limit FROM orders""")
def code_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("a"), F.repeat(F.lit("_b"), (F.col("o_custkey") % 3).cast("int")))
    return table(spark, sf_dir, "orders").select(k.alias("key"), T.delimiter_count(text).cast("long").alias("delimiters"), T.team_code_over_limit((k * 7).cast("string")).alias("over_limit"))


@query(f"""WITH {SETTLEMENTS} SELECT key, CASE WHEN key % 3 <> 0 THEN lpad(CAST(key AS VARCHAR), 6, '0') END AS team, CASE WHEN key % 3 <> 0 THEN ward END AS ward, CASE WHEN key % 3 <> 0 THEN lga END AS lga FROM settlements""")
def plan_file_names(spark, sf_dir):
    name = F.concat(F.lit("DIP of Team "), F.lpad(F.col("key").cast("string"), 6, "0"), F.lit(" "), F.col("ward"), F.lit(" ward, "), F.col("lga"), F.lit(" LGA.pdf"))
    s = settlements(spark, sf_dir).select("key", T.team_plan_name(F.when(F.col("key") % 3 != 0, name).otherwise("notes.pdf")).alias("p"))
    return s.select("key", "p.team", "p.ward", "p.lga")
