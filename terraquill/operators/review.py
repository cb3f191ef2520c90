"""Filters, notes and roll-ups of reviews: what a campaign office reads off its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill import settings as S
from terraquill.functions import text as T
from terraquill.operators import matching as M
from terraquill.roles import DataError


def in_scope(df: DataFrame, **levels: str | None) -> DataFrame:
    """Rows of the named state, LGA, ward ..., in any case; a level without a name doesn't restrict."""
    named = {c: v for c, v in levels.items() if v is not None}
    return reduce(lambda d, x: d.where(F.lower(F.trim(F.col(x[0]))) == x[1].strip().lower()), named.items(), df)


def passed(df: DataFrame, levels: list[str]) -> DataFrame:
    """Reviewed rows that pass at every level."""
    return reduce(lambda d, x: d.where(F.col(f"{x}_review") == "pass"), levels, df)


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the given order."""
    return df.select(*(c for c in columns if c in df.columns))


def map_points(df: DataFrame, lat: str, lon: str, status: str, coverage: str) -> DataFrame:
    """Rows with a plausible place, its coordinates as numbers, and status and coverage by their known names (status: else Unknown)."""
    a, b = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    good = a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0))
    return df.where(good).withColumns(
        {
            lat: a, lon: b, status: F.coalesce(T.fold_category(F.col(status), S.VISIT_ORDER), F.lit("Unknown")),
            coverage: T.fold_category(F.col(coverage), S.COVERAGE_ORDER),
        }
    )


def issue_counts(reviews: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(review, rows, issues): rows with an issue, and how many different ones, of each review table's issue column."""
    tables = [
        df.agg(F.count(c).alias("rows"), F.count_distinct(c).alias("issues")).select(F.lit(name).alias("review"), "rows", "issues")
        for name, (df, c) in reviews.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def issue_lines(df: DataFrame, issue: str, ward: str = "ward", lga: str = "lga") -> DataFrame:
    """One line of text for each row with an issue."""
    said = F.concat(F.lit("Issues Encountered in "), F.col(ward), F.lit(" ward, "), F.col(lga), F.lit(" LGA issues "), F.col(issue))
    return df.where(F.col(issue).isNotNull()).select(ward, lga, said.alias("line"))


def carried_settlements(raw: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """One row: raw rows, settlements that the plan carries, dropped ones, and those split across several rows."""
    per = plan.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).groupBy().agg(F.count("*").alias("carried"), F.count_if(F.col("n") > 1).alias("split"))
    rows = raw.agg(F.count("*").alias("raw_rows"), F.lit(0).cast("long").alias("carried"), F.lit(0).cast("long").alias("split"))
    both = rows.unionByName(per.withColumn("raw_rows", F.lit(0).cast("long"))).agg(*(F.sum(c).alias(c) for c in ("raw_rows", "carried", "split")))
    return both.withColumn("dropped", F.greatest(F.col("raw_rows") - F.col("carried"), F.lit(0)))


def shortfall(wards: DataFrame, group: list[str], message: str) -> DataFrame:
    """By group, wards with a shortfall message and the missing teams that the messages name."""
    short = wards.where(F.col(message).isNotNull())
    named = F.coalesce(F.regexp_extract(message, r"(\d+)", 1).try_cast("long"), F.lit(0))
    return short.groupBy(*group).agg(F.count("*").alias("wards"), F.sum(named).alias("teams"))


def missing_day_histogram(teams: DataFrame, missing: str, days: int = 4) -> DataFrame:
    """(day, n): how many teams lack each day; every day is listed."""
    listed = F.transform(F.split(F.coalesce(missing, F.lit("")), ","), lambda d: F.trim(d))
    counts = teams.agg(*(F.count_if(F.array_contains(listed, str(d))).alias(f"_{d}") for d in range(1, days + 1)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(str(d)).alias("day"), F.col(f"_{d}").alias("n")) for d in range(1, days + 1)))))


def layer_consistency(cells: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct settlements of both layers, and whether they hold as many settlements."""
    rows = cells.select(F.lit("cells").alias("layer"), key).unionByName(grids.select(F.lit("grids").alias("layer"), key))
    of = lambda name: F.col("layer") == name
    both = rows.agg(
        *(F.count_if(of(n)).alias(f"total_{n}") for n in ("cells", "grids")),
        *(F.count_distinct(F.when(of(n), F.col(key))).alias(f"unique_{n}") for n in ("cells", "grids")),
    )
    return both.withColumn("is_consistent", F.col("unique_cells") == F.col("unique_grids"))


def _blank(c: str | None) -> Column:
    return F.lit(True) if c is None else F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def ingest_note(df: DataFrame, lga: str | None, team: str | None, day: str | None) -> DataFrame:
    """One row: all rows, those without team and day, and distinct LGAs. A role without a column is blank everywhere."""
    lgas = F.count_distinct(F.when(~_blank(lga), F.trim(F.col(lga).cast("string")))) if lga else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("total_rows"), F.count_if(_blank(team) & _blank(day)).alias("missing_both"), lgas.alias("lgas"))


def missing_admin(df: DataFrame, lga: str | None, ward: str | None, wards: bool = False) -> DataFrame:
    """One row: all rows, and those without an LGA or, at ward level, without a ward."""
    blank = _blank(lga) | (_blank(ward) if wards else F.lit(False))
    return df.agg(F.count("*").alias("total_rows"), F.count_if(blank).alias("missing"))


def dropped_rows(original: DataFrame, returned: DataFrame) -> DataFrame:
    """One row: rows before and after, and their difference."""
    rows = original.select(F.lit(False).alias("after")).unionByName(returned.select(F.lit(True).alias("after")))
    both = rows.agg(F.count_if(~F.col("after")).alias("original"), F.count_if("after").alias("returned"))
    return both.withColumn("dropped", F.col("original") - F.col("returned"))


def check_team_codes(df: DataFrame, team: str, listed: int = 20) -> DataFrame:
    """The table, if no team code is above the limit; else an error that names some of them."""
    bad = df.where(T.team_code_over_limit(F.col(team))).select(team).distinct().orderBy(team).limit(listed).collect()
    if bad:
        raise DataError("invalid team codes: " + ", ".join(str(r[0]) for r in bad))
    return df


def preset_values(df: DataFrame, column: str, presets: tuple[str, ...]) -> DataFrame:
    """The column's values as presets: those that are none become the one of the best partial ratio, ties to the first preset. Only
    distinct values are scored."""
    given = df.select(F.col(column).cast("string").alias("_v")).where(F.col("_v").isNotNull() & ~F.col("_v").isin(*presets)).distinct()
    options = F.posexplode(F.array(*(F.lit(p) for p in presets)))
    scored = given.select("_v", options.alias("_k", "_p")).withColumn("_s", M.scorer("partial_ratio")(F.lower("_v"), F.lower("_p")))
    best = scored.groupBy("_v").agg(F.min_by("_p", F.struct(-F.col("_s"), F.col("_k"))).alias("_best"))
    out = df.join(best, F.col(column).cast("string") == F.col("_v"), "left")
    return out.withColumn(column, F.coalesce("_best", F.col(column).cast("string"))).select(*df.columns)
