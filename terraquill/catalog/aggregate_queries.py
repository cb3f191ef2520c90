"""Summaries and cross tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.catalog.base import PLANS, SETTLEMENTS, STATUSES, TRACKS, plans, query, settlements, table, tracks
from terraquill.operators import aggregates as A
from terraquill.operators import relational as L

_PS = f"{PLANS}, {SETTLEMENTS}, ps AS (SELECT plans.*, state, lga, ward, settlement, balance, x, y FROM plans JOIN settlements USING (key))"


def _ps(spark, sf_dir):
    return plans(spark, sf_dir).join(settlements(spark, sf_dir).drop("nation", "segment"), "key")


@query(f"""WITH {_PS}, d AS (SELECT DISTINCT ward, plan % 50 AS cell, status FROM ps)
SELECT ward, count(*) FILTER (status = 'Visited') AS visited, count(*) FILTER (status = 'Not Yet Visited') AS not_yet_visited, count(*) FILTER (status IN ('Visited', 'Not Yet Visited')) AS total,
  round(count(*) FILTER (status = 'Visited') / nullif(count(*) FILTER (status IN ('Visited', 'Not Yet Visited')), 0), 6) AS coverage FROM d GROUP BY ward""")
def status_matrix_coverage(spark, sf_dir):
    cells = _ps(spark, sf_dir).withColumn("cell", F.col("plan") % 50)
    m = A.status_matrix(cells, ["ward"], "cell", "status", (S.VISITED, S.NOT_YET_VISITED))
    return m.withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {PLANS} SELECT status, count(*) AS n FROM plans GROUP BY 1")
def count_by_status(spark, sf_dir):
    return A.count_by(plans(spark, sf_dir), "status")


_CROSS = """SELECT state, count(*) FILTER (status = 'Visited') AS visited, count(*) FILTER (status = 'Not Yet Visited') AS not_yet_visited,
  count(*) FILTER (status = 'Not Visited') AS not_visited, count(*) AS planned FROM ps GROUP BY state"""


@query(f"""WITH {_PS}, c AS ({_CROSS}) SELECT * FROM c UNION ALL
SELECT 'Total', CAST(sum(visited) AS BIGINT), CAST(sum(not_yet_visited) AS BIGINT), CAST(sum(not_visited) AS BIGINT), CAST(sum(planned) AS BIGINT) FROM c""")
def crosstab_planned(spark, sf_dir):
    return A.with_total_row(A.crosstab(_ps(spark, sf_dir), ["state"], "status", STATUSES, "planned"), "state")


@query(f"""WITH {_PS}, c AS ({_CROSS}) SELECT state, visited, not_yet_visited, not_visited, round(visited / planned, 6) AS visited_share,
  round(not_yet_visited / planned, 6) AS not_yet_visited_share, round(not_visited / planned, 6) AS not_visited_share FROM c""")
def row_proportions(spark, sf_dir):
    names = ["visited", "not_yet_visited", "not_visited"]
    t = A.proportions(A.crosstab(_ps(spark, sf_dir), ["state"], "status", STATUSES, None), names)
    return t.withColumns({f"{c}_share": F.round(f"{c}_share", 6) for c in names})


@query(f"""WITH {PLANS}, l AS (SELECT unnest(range(4)) AS position, unnest(['Visited', 'Not Yet Visited', 'Not Visited', 'Never']) AS label)
SELECT CAST(position AS INTEGER) AS position, label, count(plan) AS n FROM l LEFT JOIN plans ON status = label GROUP BY 1, 2""")
def fixed_order_counts(spark, sf_dir):
    return A.fixed_order_counts(plans(spark, sf_dir), "status", (*STATUSES, "Never"))


@query(f"""WITH {_PS} SELECT count(DISTINCT lga) AS lgas, count(DISTINCT state || ' | ' || lga) AS state_lgas, count(DISTINCT ward) AS wards,
  count(DISTINCT state || ' | ' || lga || ' | ' || ward || ' | ' || settlement) AS settlements FROM ps""")
def distinct_keys(spark, sf_dir):
    return A.distinct_keys(
        _ps(spark, sf_dir), {"lgas": ["lga"], "state_lgas": ["state", "lga"], "wards": ["ward"], "settlements": ["state", "lga", "ward", "settlement"]}
    )


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT lga, CASE key % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'a' END AS f1, CASE WHEN key % 5 = 0 THEN 'b' END AS f2 FROM settlements)
SELECT lga, count(*) AS total, count(*) FILTER (coalesce(trim(f1) <> '', false) OR coalesce(trim(f2) <> '', false)) AS flagged,
  count(*) FILTER (trim(f1) <> '') AS n_f1, count(*) FILTER (trim(f2) <> '') AS n_f2 FROM t GROUP BY lga""")
def flag_rates(spark, sf_dir):
    k = F.col("key")
    s = settlements(spark, sf_dir).select(
        "lga", F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, " ").otherwise("a").alias("f1"), F.when(k % 5 == 0, "b").alias("f2")
    )
    return A.flag_rates(s, ["lga"], ["f1", "f2"])


@query(f"""WITH {_PS} SELECT state, lga, ward, count(*) AS n, count(*) FILTER (status = 'Visited') AS visited, CAST(3 - grouping(state) - grouping(lga) - grouping(ward) AS INTEGER) AS level
FROM ps GROUP BY ROLLUP (state, lga, ward)""")
def drill_down(spark, sf_dir):
    aggregates = (F.count("*").alias("n"), F.count_if(F.col("status") == S.VISITED).alias("visited"))
    return A.drill_down(_ps(spark, sf_dir), ["state", "lga", "ward"], *aggregates).withColumn("level", F.col("level").cast("int"))


_DURATION = """d AS (SELECT team, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM tracks WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY team)"""


def _durations(spark, sf_dir):
    t = tracks(spark, sf_dir).where((F.col("event_type") == "click") & (F.to_date("ts") == F.lit("2024-01-05").cast("date")))
    return A.team_duration(t)


@query(f"WITH {TRACKS}, {_DURATION} SELECT team, seconds FROM d")
def team_duration(spark, sf_dir):
    return _durations(spark, sf_dir)


@query(f"""WITH {TRACKS}, {_DURATION}, m AS (SELECT greatest(CAST(round(max(seconds) / 3600) AS BIGINT), 1) AS top FROM d),
b AS (SELECT 0 AS low, 1800 AS high, '<30m' AS bin UNION ALL SELECT 1800, 3600, '<1 HR' UNION ALL
  SELECT h * 3600, (h + 2) * 3600, h || '-' || (h + 2) || ' HR' FROM (SELECT unnest(range(1, top, 2)) AS h FROM m))
SELECT CAST(low AS BIGINT) AS from_seconds, bin, count(team) AS n FROM b LEFT JOIN d ON seconds >= low AND seconds < high GROUP BY 1, 2""")
def duration_histogram(spark, sf_dir):
    return A.duration_histogram(_durations(spark, sf_dir))


_WARDS = """w AS (SELECT l_suppkey % 17 AS ward, lpad(CAST(l_partkey % 23 AS VARCHAR), 3, '0') AS team FROM lineitem)"""


def _wards(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 17).alias("ward"), F.lpad((F.col("l_partkey") % 23).cast("string"), 3, "0").alias("team")
    )


@query(f"""WITH {_WARDS}, g AS (SELECT ward, count(*) AS settlements, count(DISTINCT team) AS teams, 20 + ward % 7 AS expected FROM w GROUP BY ward),
m AS (SELECT ward, string_agg(code, ',' ORDER BY code) AS missing FROM (SELECT ward, lpad(CAST(k AS VARCHAR), 3, '0') AS code FROM g, (SELECT unnest(range(5, 31)) AS k))
  WHERE (ward, code) NOT IN (SELECT ward, team FROM w) GROUP BY ward)
SELECT g.*, CASE WHEN expected > teams THEN (expected - teams) || ' teams missing' END AS shortfall, coalesce(missing, '') AS missing_codes FROM g LEFT JOIN m USING (ward)""")
def ward_team_review(spark, sf_dir):
    w = _wards(spark, sf_dir).withColumn("want", 20 + F.col("ward") % 7).withColumn("lo", F.lit(5)).withColumn("hi", F.lit(30))
    return A.ward_team_review(w, ["ward"], "team", "want", "lo", "hi")


@query(f"""WITH {PLANS}, e AS (SELECT key % 200 AS team, d FROM plans LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(days, '\\d')) AS d) ON true),
s AS (SELECT team, list_sort(list_distinct(list(d) FILTER (d IS NOT NULL))) AS l FROM e GROUP BY team)
SELECT team, coalesce(array_to_string(l, ','), '') AS days, array_to_string(list_filter(['1', '2', '3', '4'], lambda x: NOT coalesce(list_contains(l, x), false)), ',') AS missing_days FROM s""")
def team_day_review(spark, sf_dir):
    return A.team_day_review(plans(spark, sf_dir).withColumn("team", F.col("key") % 200), ["team"], "days")


@query(f"WITH {PLANS} SELECT max(CAST(d AS INTEGER)) AS days FROM (SELECT unnest(regexp_extract_all(days, '\\d')) AS d FROM plans)")
def campaign_days(spark, sf_dir):
    return A.campaign_days(plans(spark, sf_dir), "days")


@query("""WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, ' | ') AS l FROM events GROUP BY 1), e AS (SELECT unnest(string_split(l, ' | ')) AS source FROM s)
SELECT source, count(*) AS n FROM e GROUP BY 1""")
def source_frequency(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " | ").alias("sources"))
    return A.source_frequency(s, "sources")


@query(f"""WITH {_PS} SELECT lga, CAST(sum(plan % 100) AS BIGINT) AS population, CAST(sum(CASE WHEN status = 'Visited' THEN plan % 100 ELSE 0 END) AS BIGINT) AS visited_population,
  CAST(sum(CASE WHEN status = 'Visited' THEN 0 ELSE plan % 100 END) AS BIGINT) AS missed_population, count(*) AS settlements FROM ps GROUP BY lga""")
def missed_population(spark, sf_dir):
    return A.population_totals(_ps(spark, sf_dir).withColumn("population", F.col("plan") % 100), ["lga"], "population", "status")


@query(f"WITH {PLANS} SELECT priority, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM plans GROUP BY 1")
def percent_breakdown(spark, sf_dir):
    return A.percent_breakdown(plans(spark, sf_dir), "priority")


@query(f"""WITH {_PS}, w AS (SELECT lga, ward, count(DISTINCT plan % 40) AS n FROM ps GROUP BY 1, 2) SELECT lga, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_inner FROM w GROUP BY 1""")
def hierarchical_distinct(spark, sf_dir):
    return A.hierarchical_distinct(_ps(spark, sf_dir).withColumn("team", F.col("plan") % 40), ["lga"], ["ward"], "team")


@query(f"""WITH {PLANS}, g AS (SELECT key, max(plan % 300) AS p, count(*) AS n FROM plans GROUP BY key)
SELECT CAST(sum(p) AS BIGINT) AS population, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS settlements, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) FILTER (n > 1) AS split_settlements, round(sum(p) * 0.2, 4) AS target FROM g""")
def dedup_population(spark, sf_dir):
    p = plans(spark, sf_dir).withColumn("population", F.col("plan") % 300)
    return A.deduplicated_population(p, ["key"], "population").withColumn("target", F.round("target", 4))


@query(f"""WITH {_PS} SELECT ward, round(avg(plan % 4), 6) AS mean_contact, round(avg((plan % 4) / 3), 6) AS mean_proportion, count(*) AS n FROM ps GROUP BY ward""")
def contact_by_group(spark, sf_dir):
    p = _ps(spark, sf_dir).withColumn("contact", F.col("plan") % 4).withColumn("proportion", F.col("plan") % 4 / 3)
    return A.contact_averages(p, ["ward"], "contact", "proportion").withColumns({c: F.round(c, 6) for c in ("mean_contact", "mean_proportion")})


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def top_n_recent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return A.top_recent(e, [F.desc("ts"), F.desc("event_id")], 500)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def paging(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id").orderBy("event_id").offset(100).limit(50)


@query("""WITH l AS (SELECT unnest(range(4)) AS position, unnest(['purchase', 'click', 'error', 'missing']) AS label)
SELECT CAST(position AS INTEGER) AS position, label, count(event_id) AS n FROM l LEFT JOIN events ON event_type = label GROUP BY 1, 2""")
def job_summary(spark, sf_dir):
    return A.fixed_order_counts(table(spark, sf_dir, "events"), "event_type", ("purchase", "click", "error", "missing"))


@query(f"""WITH {PLANS} SELECT CAST(sum(plan % 12) AS BIGINT) AS pages, count(*) AS teams, round(avg(plan % 12), 6) AS mean_pages, max(plan) FILTER (plan % 12 = 11) AS largest FROM plans""")
def map_book_totals(spark, sf_dir):
    t = A.map_book_totals(plans(spark, sf_dir).withColumn("pages", F.col("plan") % 12), "plan", "pages")
    return t.withColumn("mean_pages", F.round("mean_pages", 6))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1998)
SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b""")
def key_set_ops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return L.key_set_sizes(o.where("y = 1997"), o.where("y = 1998"), ["o_custkey"])
