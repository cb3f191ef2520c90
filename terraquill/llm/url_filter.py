"""URL filter: block and allow rules, and link-graph propagation for hosts that no rule decides.

1. A rule (host, path) fits a page if its host is the page's or one of its parent domains and the page's path starts with the
   rule's path. The longest rule (host and path) wins; of equally long ones, a block.
2. Hosts are seeds by the share of their pages that rules allow (trust) or block (distrust).
3. An edge goes from a page's host to every other host that the page names: in an absolute or protocol-relative link or in a mail address.
4. ``distrust``: distrust flows against the edges, ``D = (1 - DAMPING) * blocked + DAMPING * mean of D over the hosts linked to``
   (``D = blocked`` for a host without links): the chance that a walk along links ends at a blocked page.
   ``trust``: PageRank along the edges personalised on allowed shares, divided by the PageRank personalised on
   all hosts: the share of the walks ending at the host that began at an allowed page.
5. A host is blocked if distrust reaches ``BLOCK_AT`` and exceeds trust. A page has its rule's verdict, else its host's.

Each round is two joins on the host and one sum with partial aggregation, written to the shared folder; rounds end when no score
moves by ``TOLERANCE``, after ``ROUNDS`` at most (what is left then is below DAMPING**ROUNDS). Scores are rounded to six digits.

Defined cases: a null url or one without ``://`` has an empty host and path, meets no rule and is allowed; a null html names no
host. A rule's path is never empty (``net/`` has the path ``/``), so it does not fit an empty path. Repeated rows each give their row and count each as a page.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm.common import Scratch, bounded_broadcast, lower_ascii

#: Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 20
TOLERANCE = 1e-6
BLOCK_AT = 0.5
#: Rows of rules, or of hosts, that are broadcast; beyond it the tables are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: What names a host: an absolute link, a protocol-relative link, a mail address.
_NAMED = r"""(?:://|["'=\x09-\x0D\x20]//|@)([^/?#"'<>@&;,()\x09-\x0D\x20]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return lower_ascii(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def named_hosts(html: Column) -> Column:
    """The hosts that a page names, lower-cased, without full stops at their end; only names with a full stop inside."""
    found = F.transform(F.regexp_extract_all(html, F.lit(_NAMED), 1), lambda h: F.rtrim(lower_ascii(h), F.lit(".")))
    return F.coalesce(F.array_distinct(F.filter(found, lambda h: h.contains("."))), F.array().cast("array<string>"))


def rule_table(spark, rules: tuple = RULES) -> DataFrame:
    """(r_host, r_path, rule, verdict) of rules given as (verdict, host/path)."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    host = F.substring_index("rule", "/", 1)
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.select(host.alias("r_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("r_path"), "rule", "verdict")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host that any rule's host fits, the rules by falling length, blocks first."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(parents).alias("r_host")).join(bounded_broadcast(rules, BROADCAST_ROWS), "r_host")
    order = F.struct((-F.length("rule")).alias("length"), (F.col("verdict") != "block").alias("kind"), "rule", "r_path", "verdict")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages (with host and path) with ``rule`` and ``rule_verdict``, both null where no rule fits."""
    of = rules_of_hosts(pages.select("host").distinct(), rules).withColumnRenamed("host", "of_host")
    joined = pages.join(bounded_broadcast(of, BROADCAST_ROWS), F.col("host") == F.col("of_host"), "left")
    first = F.expr("get(filter(rules, r -> startswith(path, r.r_path)), 0)")
    return joined.withColumn("first", first).select(
        *pages.columns, F.col("first.rule").alias("rule"), F.col("first.verdict").alias("rule_verdict")
    )


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, trust, distrust) of all hosts that are seeds or linked. ``seeds``: host, allowed, blocked (shares of its pages);
    ``edges``: src, dst, n (how many pages of src name dst)."""
    out = edges.groupBy(F.col("src").alias("o_src")).agg(F.sum("n").alias("total"))
    walk = scratch.save(edges.join(out, F.col("src") == F.col("o_src")).select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "walk")
    named = walk.select(F.col("src").alias("host"), F.lit(True).alias("links")).union(walk.select("dst", F.lit(False)))
    nodes = named.groupBy("host").agg(F.bool_or("links").alias("links")).join(seeds, "host", "full").select(
        "host", F.coalesce("links", F.lit(False)).alias("links"),
        F.coalesce("allowed", F.lit(0.0)).alias("allowed"), F.coalesce("blocked", F.lit(0.0)).alias("blocked"),
    )
    nodes = scratch.save(nodes, "nodes")
    start = nodes.select("host", F.col("allowed").alias("t"), F.lit(1.0).alias("r"), F.col("blocked").alias("d"))
    scores = scratch.save(start, "scores0")
    for k in range(1, ROUNDS + 1):
        forward = walk.join(scores, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("w") * F.col("t")).alias("t"), (F.col("w") * F.col("r")).alias("r"), F.lit(0.0).alias("d")
        )
        back = walk.join(scores, F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), F.lit(0.0).alias("r"), (F.col("w") * F.col("d")).alias("d")
        )
        got = forward.union(back).groupBy(F.col("host").alias("g_host")).agg(*(F.sum(c).alias(f"g_{c}") for c in "trd"))
        old = scores.select(F.col("host").alias("o_host"), *(F.col(c).alias(f"o_{c}") for c in "trd"))
        flow = lambda c, base: (1 - DAMPING) * base + DAMPING * F.coalesce(F.col(f"g_{c}"), F.lit(0.0))
        new = (
            nodes.join(got, F.col("host") == F.col("g_host"), "left").join(old, F.col("host") == F.col("o_host"))
            .select(
                "host", flow("t", F.col("allowed")).alias("t"), flow("r", F.lit(1.0)).alias("r"),
                F.when(F.col("links"), flow("d", F.col("blocked"))).otherwise(F.col("blocked")).alias("d"), "o_t", "o_r", "o_d",
            )
            .select("host", "t", "r", "d", F.greatest(*(F.abs(F.col(c) - F.col(f"o_{c}")) for c in "trd")).alias("moved"))
        )
        saved = scratch.save(new, f"scores{k}")
        scratch.drop(f"scores{k - 1}")
        scores = saved.drop("moved")
        if (saved.agg(F.max("moved")).first()[0] or 0.0) < TOLERANCE:
            break
    return scores.select("host", F.round(F.col("t") / F.col("r"), 6).alias("trust"), F.round("d", 6).alias("distrust"))


def filter_urls(
    pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, and its host's trust and distrust."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url_filter")
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = scratch.save(ruled(parts, rule_table(spark) if rules is None else rules), "judged")
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    named = pages.select(host.alias("src"), F.explode(named_hosts(F.col(html_col))).alias("dst")).where("src != '' and dst != '' and src != dst")
    edges = named.groupBy("src", "dst").agg(F.count("*").alias("n"))
    scores = propagate(seeds, edges, scratch).withColumnRenamed("host", "s_host")
    scored = judged.join(bounded_broadcast(scores, BROADCAST_ROWS), F.col("host") == F.col("s_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_host = F.when((distrust >= BLOCK_AT) & (distrust > trust), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
