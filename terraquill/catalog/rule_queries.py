"""Row rules over derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.catalog.base import PLANS, SETTLEMENTS, TRACKS, plans, query, settlements, table, tracks
from terraquill.functions import rules as R
from terraquill.operators import relational as L
from terraquill.plans import tracking

_COVERAGE = """CASE WHEN r IS NULL OR r = 0 THEN 'No Coverage' WHEN round_even(r, 2) < 0.5 THEN 'Poorly Covered'
  WHEN round_even(r, 2) < 0.7 THEN 'Partially Covered' ELSE 'Fully Covered' END"""


@query(f"""WITH {TRACKS} SELECT event_id, team, x, y FROM tracks
WHERE value / 100 < 1 AND hour(ts) BETWEEN 7 AND 16 AND CAST(ts AS DATE) = DATE '2024-01-05'""")
def track_validity_filter(spark, sf_dir):
    return (
        tracks(spark, sf_dir)
        .where((F.col("value") / 100 < 1) & F.hour("ts").between(7, 16) & (F.to_date("ts") == F.lit("2024-01-05").cast("date")))
        .select("event_id", "team", "x", "y")
    )


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity / 50 - 0.02, 0) AS r, CAST(l_quantity * 4 - 8 AS BIGINT) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {_COVERAGE} AS coverage, CASE WHEN m = 0 THEN NULL WHEN m BETWEEN 1 AND 12 THEN '<12 mins' WHEN m BETWEEN 13 AND 30 THEN '12 - 30 mins'
  WHEN m BETWEEN 31 AND 60 THEN '30 mins - 1 hr' WHEN m BETWEEN 61 AND 120 THEN '1 - 2 hrs' ELSE '>2 hrs' END AS time_spent FROM t""")
def coverage_and_time_class(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", R.coverage_class(F.nullif(q / 50 - 0.02, F.lit(0.0))).alias("coverage"),
        R.time_spent_class((q * 4 - 8).cast("long")).alias("time_spent"),
    )


@query(f"""WITH {PLANS}, t AS (SELECT *, CASE WHEN key % 4 = 0 THEN 'Visited' WHEN key % 4 = 1 THEN 'Not Yet Visited' END AS prev FROM plans),
u AS (SELECT *, CASE WHEN status = 'Visited' OR prev = 'Visited' THEN 'Visited' ELSE 'Not Yet Visited' END AS cumulative FROM t)
SELECT plan, cumulative, CASE WHEN days IS NOT NULL THEN cumulative END AS day, CASE cumulative WHEN 'Not Yet Visited' THEN 'Not Visited' ELSE cumulative END AS final,
  greatest(price / 600000, CASE WHEN key % 3 = 0 THEN NULL ELSE 0.4 END) AS coverage, (days IS NOT NULL OR prev IS NOT NULL) AS planned FROM u""")
def cumulative_visits(spark, sf_dir):
    k = F.col("key") % 4
    p = plans(spark, sf_dir).withColumn("prev", F.when(k == 0, S.VISITED).when(k == 1, S.NOT_YET_VISITED))
    p = p.withColumn("cumulative", R.visited(F.col("status"), F.col("prev")))
    c = F.col("cumulative")
    return p.select(
        "plan", c, R.day_status(F.col("days"), c).alias("day"), R.mop_up(c).alias("final"),
        R.final_coverage(F.col("price") / 600000, F.when(F.col("key") % 3 != 0, 0.4)).alias("coverage"),
        R.planned_so_far(F.col("days"), F.col("prev")).alias("planned"),
    )


@query(f"""WITH {PLANS} SELECT plan, coalesce(status = 'Visited' AND NOT (CASE WHEN price >= 100000 THEN plan % 60 >= 30 ELSE plan % 60 >= 15 END), false) AS reassess FROM plans""")
def visit_reassessment(spark, sf_dir):
    return plans(spark, sf_dir).select("plan", R.needs_reassessment(F.col("status"), F.col("price") / 10, F.col("plan") % 60).alias("reassess"))


@query(f"""WITH {PLANS}, r AS (SELECT *, status = 'Visited' AND NOT (CASE WHEN price >= 100000 THEN plan % 60 >= 30 ELSE plan % 60 >= 15 END) AS again FROM plans)
SELECT plan, CASE WHEN again THEN 'reevaluate' ELSE 'maintain' END AS review, CASE WHEN again THEN 'Not Yet Visited' ELSE status END AS visitation,
  CASE WHEN again THEN 0 ELSE price / 600000 END AS coverage, CASE WHEN again THEN 0 ELSE plan % 60 END AS track_count FROM r""")
def visits_reassessed(spark, sf_dir):
    p = plans(spark, sf_dir).select(
        "plan", F.col("status").alias("visitation"), (F.col("price") / 10).alias("area_sqm"), (F.col("price") / 600000).alias("coverage"), (F.col("plan") % 60).alias("track_count")
    )
    return tracking.reassess(p).select("plan", "review", "visitation", "coverage", "track_count")


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT key, CASE key % 5 WHEN 0 THEN NULL WHEN 1 THEN ' a ' WHEN 2 THEN repeat('a ', 12) ELSE settlement END AS name FROM settlements)
SELECT key, CASE WHEN name IS NULL THEN 'no settlement name' WHEN length(trim(name)) < 3 THEN 'invalid name length'
  WHEN len(string_split(trim(name), ' ')) >= 10 THEN 'review settlement name' END AS invalid_name_length FROM t""")
def name_length_flag(spark, sf_dir):
    k = F.col("key") % 5
    name = F.when(k == 0, F.lit(None)).when(k == 1, " a ").when(k == 2, F.repeat(F.lit("a "), 12)).otherwise(F.col("settlement"))
    return settlements(spark, sf_dir).select("key", R.name_length_flag(name).alias("invalid_name_length"))


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT key, CASE WHEN key % 13 = 0 THEN NULL ELSE x END AS x, y FROM settlements)
SELECT key, CASE WHEN x IS NOT NULL AND count(*) OVER (PARTITION BY x, y) > 1 THEN 'stacked_point' END AS stacked_point,
  CASE WHEN count(*) OVER (PARTITION BY key % 1400) > 1 THEN 'WE_code' END AS duplicate_attribute, CASE WHEN x IS NULL THEN 'No Coordinates' END AS no_coordinates FROM t""")
def stacked_and_duplicate_flags(spark, sf_dir):
    s = settlements(spark, sf_dir).select("key", F.when(F.col("key") % 13 != 0, F.col("x")).alias("x"), "y", (F.col("key") % 1400).alias("code"))
    s = L.duplicate_flag(s, ["x", "y"], "stacked_point", ignore_nulls=True)
    s = L.duplicate_flag(s, ["code"], "WE_code", "duplicate_attribute")
    return s.select("key", "stacked_point", "duplicate_attribute", R.missing_coordinates_flag(F.col("x"), F.col("y")).alias("no_coordinates"))


_POP = "(CASE WHEN plan % 9 = 0 THEN NULL ELSE CAST(price AS BIGINT) % 900 END)"
_TAR = "(CASE WHEN plan % 10 = 0 THEN NULL ELSE CAST(price AS BIGINT) % 700 END)"
_HH = "(CASE WHEN plan % 8 = 0 THEN NULL ELSE plan % 30 END)"
_NUMBERS = f"""numbers AS (SELECT plan, CAST({_POP} AS DOUBLE) AS pop, CAST({_TAR} AS DOUBLE) AS tar, CAST({_HH} AS DOUBLE) AS hh FROM (SELECT plan, trunc(price) AS price FROM plans))"""
_FLAGS = """flags AS (SELECT *, CASE WHEN pop IS NULL AND tar IS NULL THEN NULL WHEN pop = 0 AND tar = 0 THEN NULL
    WHEN pop IS NULL OR tar IS NULL THEN 'Missing total/target Population Entry' WHEN tar >= pop THEN 'Invalid Population Entry' END AS we_population,
  CASE WHEN hh IS NULL AND tar IS NULL AND pop IS NULL THEN NULL WHEN hh = 0 AND tar = 0 AND pop = 0 THEN NULL
    WHEN (hh IS NULL OR hh = 0) AND (tar IS NOT NULL OR pop IS NOT NULL) THEN 'Missing Settlement Household'
    WHEN round_even(tar / hh, 0) > 15 THEN CAST(CAST(round_even(tar / hh, 0) AS BIGINT) AS VARCHAR) || ' children per household should be reviewed'
    WHEN round_even(pop / hh, 0) > 40 THEN CAST(CAST(round_even(pop / hh, 0) AS BIGINT) AS VARCHAR) || ' people per household should be reviewed' END AS we_household FROM numbers)"""


def _numbers(spark, sf_dir):
    k, price = F.col("plan"), F.floor("price").cast("long")
    return plans(spark, sf_dir).select(
        "plan", F.when(k % 9 != 0, price % 900).cast("double").alias("pop"), F.when(k % 10 != 0, price % 700).cast("double").alias("tar"),
        F.when(k % 8 != 0, k % 30).cast("double").alias("hh"),
    )


@query(f"WITH {PLANS}, {_NUMBERS}, {_FLAGS} SELECT plan, we_population, we_household FROM flags")
def population_checks(spark, sf_dir):
    pop, tar, hh = (F.col(c) for c in ("pop", "tar", "hh"))
    return _numbers(spark, sf_dir).select("plan", R.population_flag(pop, tar).alias("we_population"), R.household_flag(hh, tar, pop).alias("we_household"))


@query(f"""WITH {PLANS}, {_NUMBERS}, {_FLAGS} SELECT plan, CASE WHEN we_population IS NULL THEN pop WHEN coalesce(pop, 0) = 0 AND coalesce(tar, 0) <> 0 THEN round_even(tar / 0.2, 0)
    WHEN tar > 0.4 * pop THEN round_even(tar / 0.2, 2) ELSE pop END AS population,
  CASE WHEN we_population IS NOT NULL AND coalesce(pop, 0) <> 0 AND coalesce(tar, 0) = 0 THEN floor(pop * 0.2) ELSE tar END AS target,
  CASE WHEN we_household IS NULL THEN hh WHEN tar >= 8 THEN round_even(tar / 8, 0) ELSE round_even(pop / 10, 0) END AS households FROM flags""")
def population_repair(spark, sf_dir):
    n = _numbers(spark, sf_dir)
    pop, tar, hh = (F.col(c) for c in ("pop", "tar", "hh"))
    n = n.withColumn("wp", R.population_flag(pop, tar)).withColumn("wh", R.household_flag(hh, tar, pop))
    return n.select(
        "plan", R.repaired_population(pop, tar, F.col("wp")).alias("population"), R.repaired_target(pop, tar, F.col("wp")).alias("target"),
        R.repaired_households(hh, tar, pop, F.col("wh")).alias("households"),
    )


@query("""SELECT p_partkey AS key, CASE WHEN NOT regexp_matches(p_name, '^\\d+') THEN 'Wrong Entry' END AS we_name,
  CASE WHEN NOT regexp_matches(CAST(p_size AS VARCHAR), '^\\d+') THEN 'Wrong Entry' END AS we_size,
  CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'Invalid Entry' END AS we_type,
  abs(TRY_CAST(p_retailprice / 8 AS DOUBLE)) <= 180 AS good_coordinate FROM part""")
def entry_checks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), R.numeric_entry_flag(F.col("p_name")).alias("we_name"), R.numeric_entry_flag(F.col("p_size")).alias("we_size"),
        R.preset_flag(F.col("p_type"), ("ECONOMY", "STANDARD")).alias("we_type"), R.valid_coordinate((F.col("p_retailprice") / 8).cast("string")).alias("good_coordinate"),
    )


_ATTRIBUTES = """attributes AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Y' WHEN 2 THEN 'N' ELSE 'Q' END AS sec,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Fully Accessible' WHEN 2 THEN 'Inaccessible' WHEN 3 THEN 'Partially Accessible' ELSE 'Maybe' END AS acc,
  CASE WHEN c_custkey % 3 = 0 THEN 'Terrain' END AS reason, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS urban,
  CASE WHEN c_custkey % 6 < 3 THEN 'Y' ELSE 'N' END AS rural, CASE WHEN c_custkey % 7 < 3 THEN 'Y' ELSE 'N' END AS scattered,
  CASE c_custkey % 9 WHEN 0 THEN 'Abandoned' WHEN 1 THEN 'Migrated' ELSE 'Inhabited' END AS hab,
  CASE WHEN c_custkey % 10 = 0 THEN 'does not EXIST' WHEN c_custkey % 10 = 1 THEN 'fine' END AS comment FROM customer)"""
_CONSISTENCY = """consistency AS (SELECT *, CASE WHEN sec IS NULL OR acc IS NULL THEN NULL WHEN acc = 'Maybe' OR sec = 'Q' THEN 'Invalid Entry'
    WHEN sec = 'Y' AND acc = 'Fully Accessible' THEN 'Cannot be security compromised and ' || acc
    WHEN sec = 'N' AND acc <> 'Fully Accessible' THEN 'Cannot be ' || acc || ' accessibility and not security compromised'
    WHEN sec = 'Y' AND reason IS NULL THEN 'Reason for Security Compromised not Provided'
    WHEN reason IS NOT NULL AND acc = 'Fully Accessible' THEN acc || ' settlement should not have ' || reason || ' reason for inaccessibility' END AS habitation_fidelity,
  CASE WHEN urban = rural AND rural = scattered THEN 'urban, rural and scattered cannot have the same ' || rural || ' value'
    WHEN urban = 'Y' AND scattered = 'Y' THEN 'urban and scattered cannot be both be Y' END AS settlement_type_fidelity,
  CASE WHEN reason IS NULL AND acc IS NOT NULL AND acc <> 'Fully Accessible' THEN 'Missing Reason for Inaccessibility Entry' END AS we_reason FROM attributes)"""


def _attributes(spark, sf_dir):
    k = F.col("c_custkey")
    choose = lambda m, *v: F.element_at(F.array(*(F.lit(x).cast("string") for x in v)), (k % m + 1).cast("int"))
    yn = lambda c: F.when(c, "Y").otherwise("N")
    return table(spark, sf_dir, "customer").select(
        k.alias("key"), choose(4, None, "Y", "N", "Q").alias("sec"),
        choose(5, None, "Fully Accessible", "Inaccessible", "Partially Accessible", "Maybe").alias("acc"),
        F.when(k % 3 == 0, "Terrain").alias("reason"), yn(k % 2 == 0).alias("urban"), yn(k % 6 < 3).alias("rural"), yn(k % 7 < 3).alias("scattered"),
        F.when(k % 9 == 0, "Abandoned").when(k % 9 == 1, "Migrated").otherwise("Inhabited").alias("hab"),
        F.when(k % 10 == 0, "does not EXIST").when(k % 10 == 1, "fine").alias("comment"),
    )


def _consistency(spark, sf_dir):
    sec, acc, reason = F.col("sec"), F.col("acc"), F.col("reason")
    return (
        _attributes(spark, sf_dir)
        .withColumn("habitation_fidelity", R.habitation_flag(sec, acc, reason))
        .withColumn("settlement_type_fidelity", R.settlement_type_flag(F.col("urban"), F.col("rural"), F.col("scattered")))
        .withColumn("we_reason", R.missing_reason_flag(reason, acc))
    )


@query(f"WITH {_ATTRIBUTES}, {_CONSISTENCY} SELECT key, habitation_fidelity, settlement_type_fidelity, we_reason FROM consistency")
def consistency_checks(spark, sf_dir):
    return _consistency(spark, sf_dir).select("key", "habitation_fidelity", "settlement_type_fidelity", "we_reason")


@query(f"""WITH {_ATTRIBUTES}, {_CONSISTENCY}, f AS (SELECT *, CASE WHEN coalesce(habitation_fidelity, settlement_type_fidelity, we_reason) IS NOT NULL THEN 'Flagged' END AS is_flagged,
  CASE WHEN key % 13 = 0 THEN 'No Coordinates' END AS no_coordinates, coalesce(regexp_matches(comment, '(?i)exist|unknown|duplicate|migrate|abandoned|state|remove'), false) OR hab IN ('Abandoned', 'Migrated') AS is_invalid FROM consistency)
SELECT key, is_flagged, is_invalid, CASE WHEN is_flagged IS NULL THEN NULL WHEN coalesce(habitation_fidelity, settlement_type_fidelity) IS NOT NULL THEN 'Major Flag' ELSE 'Minor Flag' END AS flag_level,
  CASE WHEN is_invalid THEN 'Validated Unknown' WHEN is_flagged IS NULL THEN 'Validated' WHEN no_coordinates IS NOT NULL THEN 'Not Validated' ELSE 'Validation Ongoing' END AS validation_status,
  nullif(concat_ws(', ', no_coordinates, we_reason), '') AS gis_feedback FROM f""")
def validation_status(spark, sf_dir):
    c = _consistency(spark, sf_dir)
    h, t, w = (F.col(x) for x in ("habitation_fidelity", "settlement_type_fidelity", "we_reason"))
    c = c.withColumn("is_flagged", R.flagged(h, t, w)).withColumn("no_coordinates", F.when(F.col("key") % 13 == 0, "No Coordinates"))
    c = c.withColumn("is_invalid", R.excluded(F.col("comment"), F.col("hab")))
    return c.select(
        "key", "is_flagged", "is_invalid", R.flag_level(F.col("is_flagged"), h, t).alias("flag_level"),
        R.validation_status(F.col("is_invalid"), F.col("hab"), F.col("is_flagged"), F.col("no_coordinates")).alias("validation_status"),
        R.feedback(F.col("no_coordinates"), w).alias("gis_feedback"),
    )


@query(f"""WITH {SETTLEMENTS} SELECT key, CASE lower(segment) WHEN 'building' THEN 'Y' ELSE 'N' END AS urban, 'N' AS rural, 'N' AS scattered FROM settlements""")
def category_onehot(spark, sf_dir):
    category = F.when(F.col("segment") == "BUILDING", " Urban ").otherwise("other")
    return settlements(spark, sf_dir).select("key", *R.category_flags(category))


@query("""WITH t AS (SELECT o_orderkey AS plan, [CASE WHEN o_orderkey % 2 = 0 THEN 'Visited' ELSE 'Not Visited' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Visited' WHEN o_orderkey % 3 = 1 THEN 'Not Visited' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Not Found' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'Visited' END] AS v FROM orders),
n AS (SELECT *, len(list_filter(v, lambda x: x = 'Visited')) AS seen, len(list_filter(v, lambda x: x IN ('Visited', 'Not Visited'))) AS known FROM t)
SELECT plan, CAST(seen AS BIGINT) AS contact, CASE WHEN known > 0 THEN round_even(seen / known, 2) ELSE 0 END AS contact_proportion,
  CASE WHEN list_contains(v, 'Visited') THEN 'Visited' ELSE 'Not Visited' END AS visit,
  (SELECT first(x ORDER BY c DESC, i) FROM (SELECT x, count(*) AS c, min(i) AS i FROM (SELECT unnest(v) AS x, unnest(range(3)) AS i) WHERE x IS NOT NULL AND x <> 'Not Found' GROUP BY x)) AS mode FROM n""")
def contact_and_mode(spark, sf_dir):
    k = F.col("o_orderkey")
    v = [
        F.when(k % 2 == 0, S.VISITED).otherwise(S.NOT_VISITED), F.when(k % 3 == 0, S.VISITED).when(k % 3 == 1, S.NOT_VISITED),
        F.when(k % 5 == 0, "Not Found").when(k % 5 == 1, F.lit(None)).otherwise(S.VISITED),
    ]
    seen, share = R.contact(v)
    return table(spark, sf_dir, "orders").select(
        k.alias("plan"), seen.cast("long").alias("contact"), share.alias("contact_proportion"), R.harmonized_visit(v).alias("visit"), R.row_mode(v).alias("mode")
    )


@query("""SELECT o_orderkey AS plan, CASE WHEN o_orderkey % 6 = 0 THEN 'Not Found' WHEN o_orderkey % 2 = 0 THEN 'Fully Covered' WHEN o_orderkey % 3 = 0 THEN 'Poorly Covered' ELSE 'No Coverage' END AS coverage FROM orders""")
def harmonized_coverage(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.when(k % 6 == 0, F.lit(None)).when(k % 2 == 0, S.FULL).when(k % 3 == 0, S.NO_COVERAGE).otherwise("other")
    b = F.when(k % 6 == 0, F.lit(None)).when(k % 3 == 0, S.POOR)
    return table(spark, sf_dir, "orders").select(k.alias("plan"), R.harmonized_coverage([a, b]).alias("coverage"))
