"""Summaries, cross tables and time-spent aggregates. Labels are known lists, so tables need no pass to find them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill import settings as S


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_")


def status_matrix(cells: DataFrame, group: list[str], cell: str, status: str, labels: tuple[str, ...]) -> DataFrame:
    """Per group, the distinct cells of each status, their total, and the share of the first label."""
    distinct = cells.select(*group, cell, status).distinct()
    counts = distinct.groupBy(*group).agg(
        *(F.count_if(F.col(status) == x).alias(_slug(x)) for x in labels),
        F.count_if(F.col(status).isin(*labels)).alias("total"),
    )
    return counts.withColumn("coverage", F.col(_slug(labels[0])) / F.nullif(F.col("total"), F.lit(0)))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, group: list[str], status: str, labels: tuple[str, ...], total: str | None = "total") -> DataFrame:
    """Counts by label in the labels' order, zeros kept; ``total``: all rows with one of the labels. Null groups are left out."""
    known = reduce(Column.__and__, (F.col(g).isNotNull() for g in group))
    sums = [F.count_if(F.col(status) == x).alias(_slug(x)) for x in labels]
    if total:
        sums.append(F.count_if(F.col(status).isin(*labels)).alias(total))
    return df.where(known).groupBy(*group).agg(*sums)


def with_total_row(table: DataFrame, label: str, name: str = "Total") -> DataFrame:
    """The table and a row of its column sums."""
    sums = [F.sum(c).alias(c) for c in table.columns if c != label]
    return table.unionByName(table.agg(*sums).withColumn(label, F.lit(name)))


def proportions(table: DataFrame, columns: list[str]) -> DataFrame:
    total = reduce(Column.__add__, (F.col(c) for c in columns))
    return table.withColumns({f"{c}_share": F.col(c) / F.nullif(total, F.lit(0)) for c in columns})


def fixed_order_counts(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """(position, label, n) for every label, those without rows too; one aggregate, no join."""
    counts = df.agg(*(F.count_if(F.col(column) == x).alias(f"_{k}") for k, x in enumerate(labels)))
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(x).alias("label"), F.col(f"_{k}").alias("n")) for k, x in enumerate(labels)))
    return counts.select(F.inline(rows))


def percent_breakdown(df: DataFrame, column: str) -> DataFrame:
    counts = count_by(df.where(F.col(column).isNotNull()), column)
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def distinct_keys(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """One row: for each name, how many distinct combinations of its columns there are."""
    return df.agg(*(F.count_distinct(F.concat_ws(" | ", *c)).alias(name) for name, c in keys.items()))


def flag_rates(df: DataFrame, group: list[str], flags: list[str]) -> DataFrame:
    """Per group: rows, rows with any flag, and with each."""
    set_ = {f: F.coalesce(F.trim(F.col(f)) != "", F.lit(False)) for f in flags}
    any_ = reduce(Column.__or__, set_.values())
    return df.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(any_).alias("flagged"), *(F.count_if(c).alias(f"n_{f}") for f, c in set_.items())
    )


def drill_down(df: DataFrame, levels: list[str], *aggregates: Column) -> DataFrame:
    """The aggregates of every level of a hierarchy in one pass; ``level``: how many levels a row names."""
    return df.rollup(*levels).agg(*aggregates, F.grouping_id().alias("_gid")).withColumn(
        "level", F.lit(len(levels)) - F.bit_count("_gid")
    ).drop("_gid")


def team_duration(tracks: DataFrame, team: str = "team", ts: str = "ts") -> DataFrame:
    """Seconds between a team's first and last track point."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return tracks.groupBy(team).agg((seconds(F.max(ts)) - seconds(F.min(ts))).alias("seconds"))


def duration_histogram(durations: DataFrame, seconds: str = "seconds", step: int = 2) -> DataFrame:
    """(position, bin, n): under half an hour, under an hour, then ``step`` hours each up to the longest
    duration in whole hours. The last bin is left out where the steps end on that hour."""
    top = F.greatest(F.round(F.max(seconds) / 3600).cast("int"), F.lit(1))
    starts = durations.agg(top.alias("top")).select(
        F.explode(F.filter(F.sequence(F.lit(1), F.col("top"), F.lit(step)), lambda h: h < F.col("top"))).alias("from_hour")
    )
    spans = starts.select(
        (F.col("from_hour") * 3600).alias("low"), ((F.col("from_hour") + step) * 3600).alias("high"),
        F.concat(F.col("from_hour").cast("string"), F.lit("-"), (F.col("from_hour") + step).cast("string"), F.lit(" HR")).alias("bin"),
    )
    spark = durations.sparkSession
    short = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("bin")) for a, b, c in ((0, 1800, "<30m"), (1800, 3600, "<1 HR")))))
    )
    # Each duration falls into one bin, found from its hour, so the counts are an equality join.
    hour = F.floor(F.col(seconds) / 3600)
    low = (
        F.when(F.col(seconds) < 1800, 0).when(F.col(seconds) < 3600, 1800)
        .otherwise((F.floor((hour - 1) / step) * step + 1) * 3600).cast("long")
    )
    counts = durations.select(low.alias("low")).groupBy("low").agg(F.count("*").alias("n"))
    bins = short.union(spans).withColumn("low", F.col("low").cast("long"))
    return bins.join(counts, "low", "left").select(
        F.col("low").alias("from_seconds"), "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def ward_team_review(plan: DataFrame, ward: list[str], team: str, expected: str, low: str, high: str) -> DataFrame:
    """Per ward: settlements, distinct teams, the shortfall against the expected number, and the codes of
    the allocated range that no settlement has."""
    reviewed = plan.groupBy(*ward).agg(
        F.count("*").alias("settlements"), F.count_distinct(team).alias("teams"), F.max(expected).alias("expected"),
        F.collect_set(team).alias("_codes"), F.max(low).alias("_low"), F.max(high).alias("_high"),
    )
    codes = F.transform(F.sequence("_low", "_high"), lambda k: F.lpad(k.cast("string"), 3, "0"))
    short = F.col("expected") - F.col("teams")
    return reviewed.select(
        *ward, "settlements", "teams", "expected",
        F.when(short > 0, F.concat(short.cast("string"), F.lit(" teams missing"))).alias("shortfall"),
        F.array_join(F.array_sort(F.array_except(codes, "_codes")), ",").alias("missing_codes"),
    )


def team_day_review(plan: DataFrame, team: list[str], days: str, all_days: tuple[str, ...] = ("1", "2", "3", "4")) -> DataFrame:
    """Per team: the days its rows name, and those of the campaign that none does."""
    named = plan.select(*team, F.explode_outer(F.regexp_extract_all(days, F.lit(r"(\d)"), F.lit(1))).alias("_d"))
    seen = named.groupBy(*team).agg(F.array_sort(F.collect_set("_d")).alias("_days"))
    want = F.array(*(F.lit(d) for d in all_days))
    return seen.select(
        *team, F.array_join("_days", ",").alias("days"), F.array_join(F.array_except(want, "_days"), ",").alias("missing_days")
    )


def campaign_days(df: DataFrame, days: str) -> DataFrame:
    """One row: the largest single digit in the column."""
    return df.select(F.explode(F.regexp_extract_all(days, F.lit(r"(\d)"), F.lit(1))).alias("_d")).agg(F.max(F.col("_d").cast("int")).alias("days"))


def source_frequency(df: DataFrame, sources: str, delimiter: str = " | ") -> DataFrame:
    """How many rows name each source."""
    each = df.where(F.col(sources).isNotNull()).select(F.explode(F.split(sources, r" \| ")).alias("source"))
    return count_by(each.where(F.trim("source") != ""), "source")


def population_totals(df: DataFrame, group: list[str], population: str, status: str) -> DataFrame:
    """Per group: population in all, of visited settlements and of missed ones, and settlements."""
    p, seen = F.coalesce(F.col(population), F.lit(0)), F.col(status) == S.VISITED
    return df.groupBy(*group).agg(
        F.sum(p).alias("population"), F.sum(F.when(seen, p).otherwise(0)).alias("visited_population"),
        F.sum(F.when(seen, 0).otherwise(p)).alias("missed_population"), F.count("*").alias("settlements"),
    )


def hierarchical_distinct(df: DataFrame, outer: list[str], inner: list[str], item: str) -> DataFrame:
    """Distinct items per outer group, as the sum of the distinct items of its inner groups."""
    low = df.groupBy(*outer, *inner).agg(F.count_distinct(item).alias("_n"))
    return low.groupBy(*outer).agg(F.sum("_n").alias("n"), F.count("*").alias("n_inner"))


def deduplicated_population(df: DataFrame, key: list[str], population: str, share: float = 0.2) -> DataFrame:
    """One row: population with each settlement counted once (its largest entry), rows, settlements, extra
    rows, settlements with extra rows, and the target share of the population."""
    per = df.groupBy(*key).agg(F.max(population).alias("_p"), F.count("*").alias("_n"))
    return per.agg(
        F.sum("_p").alias("population"), F.sum("_n").alias("n_rows"), F.count("*").alias("settlements"),
        F.sum(F.col("_n") - 1).alias("extra_rows"), F.count_if(F.col("_n") > 1).alias("split_settlements"),
    ).withColumn("target", F.col("population") * share)


def contact_averages(df: DataFrame, group: list[str], contact: str, proportion: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.avg(contact).alias("mean_contact"), F.avg(proportion).alias("mean_proportion"), F.count("*").alias("n")
    )


def uuid_tally(df: DataFrame, column: str, valid: Column) -> DataFrame:
    """One row: distinct valid ids, further rows that repeat one, and invalid rows."""
    per = df.groupBy(F.lower(F.trim(F.col(column))).alias("_u")).agg(F.count("*").alias("_n"), F.bool_or(valid).alias("_ok"))
    return per.agg(
        F.count_if("_ok").alias("valid"),
        F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(~F.coalesce(F.col("_ok"), F.lit(False)), F.col("_n"))), F.lit(0)).alias("invalid"),
    )


def top_recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order; n is held between 1 and 200."""
    return df.orderBy(*order).limit(max(1, min(n, 200)))


def map_book_totals(df: DataFrame, team: str, pages: str) -> DataFrame:
    """One row: pages, teams, mean pages and the team with most."""
    return df.agg(
        F.sum(pages).alias("pages"), F.count(team).alias("teams"), F.avg(pages).alias("mean_pages"),
        F.max_by(team, F.struct(F.col(pages), F.col(team))).alias("largest"),
    )
