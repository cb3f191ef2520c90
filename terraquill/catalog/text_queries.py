"""Text rules over derived names."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill.catalog.base import PLANS, SETTLEMENTS, plans, query, settlements, table
from terraquill.functions import text as T

_TITLE = (
    "list_aggregate(list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+|[^\\p{{L}}]+'), "
    "lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), 'string_agg', '')"
)


@query(f"""SELECT p_partkey AS key, CAST({_TITLE.format("p_name || '-2a o''neil ' || p_brand")} AS VARCHAR) AS title FROM part""")
def title_case_key(spark, sf_dir):
    name = F.concat("p_name", F.lit("-2a o'neil "), "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.title_case(name).alias("title"))


@query()
def standardize_text(spark, sf_dir):
    """Whole texts; held against plain Python in the tests, since engines differ in the capitals of a few letters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.standardize(F.col("text")).alias("name"))


@query("""SELECT p_partkey AS key, regexp_replace(regexp_replace('ALH. ' || p_name || ' ung alhaji', '\\bAlh\\b\\.?', 'Alhaji', 'gi'), '\\bUng\\b\\.?', 'Unguwar', 'gi') AS name FROM part""")
def abbreviation_expand(spark, sf_dir):
    c = F.concat(F.lit("ALH. "), "p_name", F.lit(" ung alhaji"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.expand_abbreviations(c).alias("name"))


@query(f"""WITH {SETTLEMENTS} SELECT key, CASE WHEN key % 11 = 0 THEN NULL ELSE
  {_TITLE.format("state")} || '_' || {_TITLE.format("lga")} || '_' || {_TITLE.format("ward")} || '_' || {_TITLE.format("settlement")} END AS unique_code FROM settlements""")
def unique_code(spark, sf_dir):
    s = settlements(spark, sf_dir).withColumn("state", F.when(F.col("key") % 11 != 0, F.col("state")))
    parts = (F.col(c) for c in ("state", "lga", "ward", "settlement"))
    return s.select("key", T.unique_key(*parts).alias("unique_code"))


@query("""SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN p_name || ' PHC' WHEN 1 THEN p_name || ' HP'
  WHEN 2 THEN p_name || ' HF' ELSE p_name END AS takeoff FROM part""")
def takeoff_reorder(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("Primary Health Center "), "p_name"))
        .when(k == 1, F.concat("p_name", F.lit(" hp")))
        .when(k == 2, F.concat(F.lit("HF "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.takeoff_name(raw).alias("takeoff"))


@query("""SELECT page_id, substr(replace(replace(url, '/', '-'), '_', ' '), 1, 31) AS sheet,
  list_extract(string_split(url, '/'), -1) AS last, TRY_CAST(nullif(regexp_extract(url, '(\\d+)', 1), '') AS BIGINT) AS first_int,
  regexp_matches(url, '(?i)\\b([A-Z]|[1-9])$') AS suffixed FROM pages""")
def name_parsing(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.sheet_name(u).alias("sheet"), T.last_segment(u, "/").alias("last"),
        T.first_integer(u).alias("first_int"), T.has_suffix(u).alias("suffixed"),
    )


@query(f"""WITH {PLANS}, t AS (SELECT plan, unnest(string_split(replace(teams, '/', ';'), ';')) AS code FROM plans)
SELECT plan, CASE WHEN length(trim(code)) < 3 THEN lpad(trim(code), 3, '0') ELSE trim(code) END AS team FROM t""")
def team_split_explode_pad(spark, sf_dir):
    return plans(spark, sf_dir).select("plan", F.explode(T.team_codes(F.col("teams"))).alias("team"))


@query(f"""WITH {PLANS}, d AS (SELECT plan, list_sort(list_distinct(regexp_extract_all(days, '\\d'))) AS l FROM plans)
SELECT plan, CASE WHEN len(l) > 0 THEN 'Day ' || array_to_string(l, ', ') END AS days, CASE WHEN list_contains(l, '1') THEN 'Yes' END AS "Day 1",
  CASE WHEN list_contains(l, '2') THEN 'Yes' END AS "Day 2", CASE WHEN list_contains(l, '3') THEN 'Yes' END AS "Day 3",
  CASE WHEN list_contains(l, '4') THEN 'Yes' END AS "Day 4" FROM d""")
def activity_days(spark, sf_dir):
    d = F.col("days")
    return plans(spark, sf_dir).select("plan", T.activity_days(d).alias("days"), *T.day_flags(d, 4))


@query("""WITH u AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN md5(CAST(event_id // 6 AS VARCHAR)) WHEN 1 THEN upper(md5(CAST(event_id AS VARCHAR))) ELSE 'x' || event_id END AS id FROM events),
g AS (SELECT lower(id) AS id, count(*) AS n, bool_or(regexp_matches(lower(id), '^[0-9a-f]{32}$')) AS ok FROM u GROUP BY 1)
SELECT count(*) FILTER (ok) AS valid, CAST(sum(CASE WHEN ok THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN ok THEN 0 ELSE n END) AS BIGINT) AS invalid FROM g""")
def uuid_shape_tally(spark, sf_dir):
    from terraquill.operators.aggregates import uuid_tally

    k = F.col("event_id")
    u = (
        F.when(k % 3 == 0, F.md5(F.floor(k / 6).cast("string").cast("binary")))
        .when(k % 3 == 1, F.upper(F.md5(k.cast("string").cast("binary"))))
        .otherwise(F.concat(F.lit("x"), k))
    )
    return uuid_tally(table(spark, sf_dir, "events").select(u.alias("id")), "id", T.is_uuid(F.col("id")))


@query(f"""WITH {SETTLEMENTS} SELECT key, CAST(CAST(x / 8 AS DECIMAL(18,6)) AS VARCHAR) || '_' || CAST(CAST(y / 8 AS DECIMAL(18,6)) AS VARCHAR) AS coord,
  CASE lower(trim(segment)) WHEN 'building' THEN 'Building' WHEN 'machinery' THEN 'Machinery' END AS category FROM settlements""")
def coordinate_keys(spark, sf_dir):
    return settlements(spark, sf_dir).select(
        "key", T.coord_id(F.col("x") / 8, F.col("y") / 8).alias("coord"),
        T.fold_category(F.concat(F.lit(" "), "segment"), ("Building", "Machinery")).alias("category"),
    )


@query("""SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS TIMESTAMP) AS stamp FROM events""")
def timestamp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
    return e.select("event_id", T.parse_time(raw).alias("stamp"))
