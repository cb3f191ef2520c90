"""Windows, keys, equality joins and fuzzy joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraquill.catalog.base import PLANS, SETTLEMENTS, plans, query, settlements, table
from terraquill.functions import geometry as G
from terraquill.operators import matching as M
from terraquill.operators import relational as L


@query(f"WITH {PLANS} SELECT key, plan, status FROM plans QUALIFY row_number() OVER (PARTITION BY key ORDER BY price DESC, plan) = 1")
def keep_first(spark, sf_dir):
    p = plans(spark, sf_dir).select("key", "plan", "status", "price")
    return L.keep_first(p, ["key"], [-F.col("price"), F.col("plan")]).drop("price")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS row_id FROM part")
def row_ids(spark, sf_dir):
    return L.row_ids(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [F.col("p_brand"), F.col("p_partkey")]).drop("p_brand")


@query("""SELECT s_nationkey, s_suppkey, CAST(sum(1 + s_suppkey % 5) OVER w AS BIGINT) AS high, CAST(sum(1 + s_suppkey % 5) OVER w - s_suppkey % 5 AS BIGINT) AS low,
  chr(CAST(65 + (row_number() OVER w - 1) % 26 AS INTEGER)) AS suffix FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING)""")
def team_ranges_and_letters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (1 + F.col("s_suppkey") % 5).alias("teams"))
    s = L.running_ranges(s, ["s_nationkey"], [F.col("s_suppkey")], "teams").drop("teams")
    return L.letter_suffix(s, ["s_nationkey"], [F.col("s_suppkey")])


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT key, ward, CASE WHEN key % 4 = 0 THEN 'T' || nation % 3 WHEN key % 40 = 1 THEN 'Z' END AS takeoff FROM settlements)
SELECT key, ward, CASE WHEN min(takeoff) OVER w = max(takeoff) OVER w THEN min(takeoff) OVER w ELSE takeoff END AS takeoff FROM t WINDOW w AS (PARTITION BY ward)""")
def single_value_fill(spark, sf_dir):
    k = F.col("key")
    takeoff = F.when(k % 4 == 0, F.concat(F.lit("T"), F.col("nation") % 3)).when(k % 40 == 1, "Z")
    return L.single_value_fill(settlements(spark, sf_dir).select("key", "ward", takeoff.alias("takeoff")), ["ward"], "takeoff")


@query("""SELECT o_orderkey, o_custkey FROM orders QUALIFY o_orderkey % 3 <> 0 OR bool_and(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey)""")
def group_keep_rule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return L.drop_unless_whole_group(o, ["o_custkey"], F.col("o_orderkey") % 3 == 0)


@query(f"""WITH {PLANS}, {SETTLEMENTS}, s AS (SELECT key, count(*) AS n, max(price) AS price FROM plans WHERE status = 'Visited' GROUP BY key)
SELECT key, settlement, coalesce(n, 0) AS n, price FROM settlements LEFT JOIN s USING (key)""")
def left_summary_join(spark, sf_dir):
    s = plans(spark, sf_dir).where("status = 'Visited'").groupBy("key").agg(F.count("*").alias("n"), F.max("price").alias("price"))
    return settlements(spark, sf_dir).select("key", "settlement").join(s, "key", "left").fillna(0, ["n"])


@query(f"""WITH {PLANS}, {SETTLEMENTS} SELECT key, key IN (SELECT key FROM plans WHERE round = 1996) AS in_1996 FROM settlements""")
def source_existence(spark, sf_dir):
    return L.exists_in(settlements(spark, sf_dir).select("key"), plans(spark, sf_dir).where("round = 1996"), ["key"], "in_1996")


@query("""SELECT c_custkey AS key, coalesce(CASE WHEN o.k IS NOT NULL THEN o.status END, c_mktsegment) AS a, nullif(concat_ws(':', c_name, o.status), '') AS b, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE o.status END AS c
FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS status FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o.k""")
def update_coalesce(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("a"), F.col("c_name").alias("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c")
    )
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("a"))
    return L.update_from(base, o.withColumn("b", F.col("a")).withColumn("c", F.col("a")), ["key"], ["a"], ["b"], ["c"])


@query("""WITH r AS (SELECT p_partkey % 900 AS code, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, p_size AS size FROM part)
SELECT p_partkey AS key, (SELECT min(size) FROM r WHERE code = p_partkey) AS by_code, (SELECT min(size) FROM r WHERE r.name = p.p_name) AS by_name FROM part p""")
def fallback_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") % 900).alias("code"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.col("p_size").alias("size"))
    base = p.select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    out = L.fallback_join(base, other, ["code", "name"], "key", ["size"])
    return out.select("key", F.col("matches")[0]["size"].alias("by_code"), F.col("matches")[1]["size"].alias("by_name"))


@query("""WITH l AS (SELECT 'map_' || n_name AS page FROM nation), r AS (SELECT 'NATION_' || (k % 30) AS name FROM (SELECT unnest(range(40)) AS k)), s AS (SELECT page, string_split(page, '_') AS p FROM l),
x AS (SELECT page, array_to_string(p[i:], '_') AS suffix FROM s, (SELECT unnest(range(1, 5)) AS i) WHERE i <= len(p)), j AS (SELECT page, r.name FROM x JOIN r ON suffix = r.name)
SELECT page, name FROM j QUALIFY count(*) OVER (PARTITION BY page) = 1 AND count(*) OVER (PARTITION BY name) = 1""")
def suffix_pairing(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.concat(F.lit("map_"), "n_name").alias("page"))
    right = spark.range(40).select(F.concat(F.lit("NATION_"), F.col("id") % 30).alias("name"))
    return L.suffix_pairs(left, right, "page", "name")


@query("""WITH a AS (SELECT p_partkey AS key, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name, CAST(p_size + (p_partkey % 6 = 0)::INTEGER AS VARCHAR) AS size FROM part WHERE p_partkey % 11 <> 0)
SELECT key, 'added' AS change, NULL AS "column", NULL AS old, NULL AS new FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL
SELECT key, 'removed', NULL, NULL, NULL FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL
SELECT key, 'changed', 'name', a.name, b.name FROM a JOIN b USING (key) WHERE a.name IS DISTINCT FROM b.name UNION ALL
SELECT key, 'changed', 'size', a.size, b.size FROM a JOIN b USING (key) WHERE a.size IS DISTINCT FROM b.size""")
def dataset_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    old = p.where(k % 10 != 0).select(k.alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = p.where(k % 11 != 0).select(
        k.alias("key"), F.when(k % 7 != 0, F.col("p_name")).alias("name"), (F.col("p_size") + (k % 6 == 0).cast("int")).alias("size")
    )
    return L.dataset_diff(old, new, "key", ["name", "size"])


_LEV = "round(100 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))), 6)"


@query(f"""WITH n AS (SELECT DISTINCT p_brand AS block, p_name || 's' AS name FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_brand AS block, p_name AS ref FROM part WHERE p_partkey % 2 = 1)
SELECT block, name, ref AS match, {_LEV.format("name", "ref")} AS score FROM n JOIN r USING (block) WHERE {_LEV.format("name", "ref")} >= 80
QUALIFY row_number() OVER (PARTITION BY block, name ORDER BY {_LEV.format("name", "ref")} DESC, ref) = 1""")
def fuzzy_mapping(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("block"), F.concat("p_name", F.lit("s")).alias("name"))
    refs = p.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("block"), F.col("p_name").alias("ref"))
    return M.mapping(names, refs, "name", "ref", ["block"], 80, M.LEVENSHTEIN)


@query()
def fuzzy_best_match(spark, sf_dir):
    """Indel-based composite scores; held against brute force in the tests."""
    p = table(spark, sf_dir, "part")
    names = p.where("p_partkey % 2 = 0").select(F.col("p_type").alias("block"), F.concat(F.lit("the "), "p_name").alias("name"))
    refs = p.where("p_partkey % 2 = 1").select(F.col("p_type").alias("block"), F.col("p_name").alias("ref"))
    return M.mapping(names, refs, "name", "ref", ["block"], 80, M.scorer("weighted_ratio"))


@query(f"""WITH {SETTLEMENTS}, t AS (SELECT key, ward, 'Camp ' || substr(settlement, 15, 3) || ' site' AS name, x, y FROM settlements),
p AS (SELECT a.ward, a.key AS key_a, b.key AS key_b, a.name AS name_a, b.name AS name_b, CASE WHEN a.name = b.name THEN 100.0 ELSE {_LEV.format("a.name", "b.name")} END AS score,
  round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 3) AS metres FROM t a JOIN t b ON a.ward = b.ward AND a.key <> b.key AND (a.name < b.name OR (a.name = b.name AND a.key < b.key)))
SELECT *, CASE WHEN metres > 65 THEN 'Unlikely Potential Duplicate Review' WHEN metres > 10 AND metres < 65 THEN 'Duplicate Review' ELSE 'Duplicate Remove' END AS action FROM p WHERE score >= 92""")
def duplicate_pairs(spark, sf_dir):
    s = settlements(spark, sf_dir).select("key", "ward", F.concat(F.lit("Camp "), F.substring("settlement", 15, 3), F.lit(" site")).alias("name"), "x", "y")
    metres = lambda a, b: G.planar(F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}"))
    return M.duplicate_pairs(s, ["ward"], "key", "name", 92, M.LEVENSHTEIN, metres)
