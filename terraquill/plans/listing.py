"""Settlement lists: quality control, standardization, updates, review of submissions, plans and teams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from terraquill import settings as S
from terraquill.functions import rules as R
from terraquill.functions import text as X
from terraquill.operators import aggregates as A
from terraquill.operators import matching as M
from terraquill.operators import relational as L
from terraquill.operators import spatial
from terraquill.roles import DataError


def standardize_list(df: DataFrame, exclude: tuple[str, ...] = ("unique_code", "eha_guid", "globalid")) -> DataFrame:
    """All string columns in standard form, abbreviations written out, and the key built anew."""
    changed = {
        f.name: X.standardize(X.expand_abbreviations(F.col(f.name)))
        for f in df.schema
        if f.dataType.simpleString() == "string" and f.name not in exclude
    }
    out = df.withColumns(changed)
    if {"state", "lga", "ward", "settlement"} <= set(df.columns):
        out = out.withColumn("unique_code", X.unique_key(*(F.col(c) for c in ("state", "lga", "ward", "settlement"))))
    return out


def attribute_checks(df: DataFrame, allow_zero: tuple[str, ...] = ()) -> DataFrame:
    """Entry and consistency flags for the attributes that the table has. ``allow_zero``: numeric attributes that take any entry."""
    have, out = set(df.columns), {}
    numbers = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    c = F.col
    for name in S.YES_NO_COLUMNS:
        if name in have:
            out[f"WE_{name}"] = R.preset_flag(c(name), S.YES_NO)
    for name, options in S.PRESETS.items():
        if name in have:
            out[f"WE_{name}"] = R.preset_flag(c(name), options)
    for name in S.NUMERIC_COLUMNS:
        if name in have:
            out[f"WE_{name}"] = R.numeric_entry_flag(c(name), name in allow_zero, name in numbers)
    if {"set_population", "set_target"} <= have:
        out["WE_population"] = R.population_flag(c("set_population"), c("set_target"))
        if "number_of_household" in have:
            out["WE_household"] = R.household_flag(c("number_of_household"), c("set_target"), c("set_population"))
    if {"reasons_for_inaccessibility", "accessibility_status"} <= have:
        out["WE_reasons_for_inaccessibility"] = F.coalesce(
            R.missing_reason_flag(c("reasons_for_inaccessibility"), c("accessibility_status")), out["WE_reasons_for_inaccessibility"]
        )
        if "security_compromised" in have:
            out["habitation_fidelity"] = R.habitation_flag(c("security_compromised"), c("accessibility_status"), c("reasons_for_inaccessibility"))
    if {"urban", "rural", "scattered"} <= have:
        out["settlement_type_fidelity"] = R.settlement_type_flag(c("urban"), c("rural"), c("scattered"))
    return df.withColumns(out)


def global_id_flag(df: DataFrame, column: str = "eha_guid") -> DataFrame:
    """``WE_<column>``: missing and repeated global ids. Only ids that occur twice are joined back, so missing ones meet nowhere."""
    twice = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").select(column, F.lit(True).alias("_twice"))
    flag = F.when(F.col(column).isNull(), "No UUID").when(F.col("_twice"), "Duplicate UUID")
    return df.join(twice, column, "left").withColumn(f"WE_{column}", flag).select(*df.columns, f"WE_{column}")


def _surrounding(points: DataFrame, boundaries: DataFrame, key: str, levels: list[str], size: float) -> DataFrame:
    """The points with the names of the boundary around them, as _b_<level>; the first by name where boundaries overlap."""
    bounds = boundaries.select("ring", *(F.col(x).alias(f"_b_{x}") for x in levels))
    inside = spatial.points_in_polygons(points.select(key, "x", "y"), bounds, "ring", size=size)
    inside = L.keep_first(inside.select(key, *(f"_b_{x}" for x in levels)), [key], [F.col(f"_b_{x}") for x in levels])
    return points.join(inside, key, "left")


def boundary_flags(points: DataFrame, boundaries: DataFrame, key: str, levels: list[str], cutoff: float = S.BOUNDARY_CUTOFF, exact: bool = False, size: float = 50.0) -> DataFrame:
    """The first admin level, from the widest on, whose name is missing or differs from that of the boundary around the point:
    ``boundary_issues``. The state's name is compared by partial ratio, others by token set ratio, once for each distinct pair. A point
    without coordinates is not flagged. ``exact``: names are compared in lower case, and a missing name of the point's own ends the
    comparison without a flag."""
    out = _surrounding(points, boundaries, key, levels, size)
    flag = F.when(F.col(f"_b_{levels[0]}").isNull() & (F.col("x").isNull() | F.col("y").isNull()), F.lit(None).cast("string"))
    for level in levels:
        own, other = F.lower(level), F.lower(f"_b_{level}")
        if exact:
            flag = flag.when(own.isNull(), F.lit(None).cast("string"))
            differs = own != other
        else:
            score = M.scorer("partial_ratio" if level == "state" else "token_set_ratio")
            pairs = out.select(own.alias("_p"), other.alias("_q")).distinct().where("_p is not null and _q is not null")
            bad = pairs.where("_p != _q").withColumn("_s", score(F.col("_p"), F.col("_q"))).where(F.col("_s") < cutoff).select("_p", "_q", F.lit(True).alias(f"_bad_{level}"))
            out = out.join(bad, (own == F.col("_p")) & (other == F.col("_q")), "left").drop("_p", "_q")
            differs = own.isNull() | F.coalesce(f"_bad_{level}", F.lit(False))
        flag = flag.when(other.isNull() | differs, f"Outside {S.LEVEL_TITLES.get(level, level)}")
    return out.withColumn("boundary_issues", flag).select(*points.columns, "boundary_issues")


def settlement_qc(df: DataFrame, key: str, boundaries: DataFrame | None = None, levels: tuple[str, ...] = ("lga",)) -> DataFrame:
    """Names, duplicates, coordinates, boundaries, proximity, entries and consistency; flags, level, status and feedback.

    Rows whose comment or status tells that the settlement is gone take part in no duplicate or proximity check.
    """
    comment = F.col("comment") if "comment" in df.columns else F.lit(None).cast("string")
    habitation = F.col("habitational_status") if "habitational_status" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("is_invalid", R.excluded(comment, habitation))
    live = df.where(~F.col("is_invalid"))
    live = live.withColumn("invalid_name_length", R.name_length_flag(F.col("settlement")))
    live = live.withColumn("no_coordinates", R.missing_coordinates_flag(F.col("x"), F.col("y")))
    live = L.duplicate_flag(live, ["x", "y"], "stacked_point", ignore_nulls=True)
    live = L.duplicate_flag(live, ["unique_code"], "duplicate_attribute")
    if "eha_guid" in live.columns:
        live = global_id_flag(live)
    if boundaries is not None:
        live = boundary_flags(live, boundaries, key, list(levels))
    near = spatial.neighbours(live.where("x is not null and y is not null").select(key, "x", "y"), S.NEAREST_METRES, key, farthest=True)
    near = near.select(key, R.distance_class(F.col("distance")).alias("proximity_issues"))
    live = attribute_checks(live.join(near, key, "left"))
    issues = [c for c in live.columns if c in S.FEEDBACK_COLUMNS or c.startswith("WE_") or c.endswith("_fidelity")]
    live = live.withColumn("is_flagged", R.flagged(*(F.col(c) for c in issues)))
    major = [F.col(c) for c in S.MAJOR_FLAGS if c in live.columns]
    live = live.withColumn("flag_level", R.flag_level(F.col("is_flagged"), *major))
    live = live.withColumn("gis_feedback", R.feedback(*(F.col(c) for c in S.FEEDBACK_COLUMNS if c in live.columns)))
    all_ = live.unionByName(df.where("is_invalid"), allowMissingColumns=True)
    return all_.withColumn(
        "validation_status", R.validation_status(F.col("is_invalid"), habitation, F.col("is_flagged"), F.col("no_coordinates"))
    )


def review_submissions(submissions: DataFrame, boundaries: DataFrame, key: str, levels: list[str], score: M.Scorer, cutoff: float = S.SUBMISSION_CUTOFF, size: float = 50.0) -> DataFrame:
    """Pass or fail for each admin level of a submission against the boundary around its point."""
    out = _surrounding(submissions, boundaries, key, levels, size)
    for level in levels:
        ok = F.coalesce(score(F.lower(level), F.lower(f"_b_{level}")) >= cutoff, F.lit(False))
        out = out.withColumn(f"{level}_review", F.when(ok, "pass").otherwise("fail"))
    return out.drop(*(f"_b_{x}" for x in levels))


def exploded_plan(plan: DataFrame, team: str = "team", days: str = "days") -> DataFrame:
    """One row for each team of a plan row that has a team or a day; codes padded, days in standard form."""
    kept = plan.where(F.col(team).isNotNull() | F.col(days).isNotNull())
    return kept.withColumn(team, F.explode_outer(X.team_codes(F.col(team)))).withColumn(days, X.activity_days(F.col(days)))


def validate_plan(plan: DataFrame, allocation: DataFrame, ward: list[str]) -> dict[str, DataFrame]:
    """Review tables of a plan: wards (teams against their allocation), teams (days), and rows whose code is out of range.
    ``allocation``: ward columns, expected, low, high."""
    rows = exploded_plan(plan)
    joined = rows.join(allocation, ward, "left")
    code = F.col("team").try_cast("int")
    return {
        "wards": A.ward_team_review(joined.where("low is not null"), ward, "team", "expected", "low", "high"),
        "teams": A.team_day_review(rows.where("team is not null"), [*ward, "team"], "days"),
        "out_of_range": joined.where(~F.coalesce(code.between(F.col("low"), F.col("high")), F.lit(False))),
    }


def team_plans(plan: DataFrame, days: int = 4) -> DataFrame:
    """The rows of each team with one column for each day, in the order that pages are printed in."""
    rows = exploded_plan(plan)
    return rows.select("*", *X.day_flags(F.col("days"), days)).orderBy("team", "days")


def take_off_codes(points: DataFrame, wards: DataFrame, ward: str, ward_code: str, order: list[Column]) -> DataFrame:
    """Take-off points with a code: their ward's code and a letter, by order within the ward."""
    codes = L.keep_first(wards.select(ward, ward_code), [ward], [F.col(ward_code)])
    lettered = L.letter_suffix(points.join(codes, ward, "left"), [ward], order)
    return lettered.withColumn("take_off_code", F.concat(ward_code, "suffix")).drop("suffix")


def one_state(df: DataFrame, state: str = "state") -> DataFrame:
    """The rows with a state, if they all have the same; else an error that names some of them. Two names are looked at, whatever the table's size."""
    named = df.where(F.col(state).isNotNull())
    found = sorted(r[0] for r in named.select(state).distinct().limit(2).collect())
    if len(found) != 1:
        raise DataError(f"one state is expected, not {', '.join(found) or 'none'}")
    return named


def update_list(master: DataFrame, validated: DataFrame, reference: DataFrame, key: list[str], score: M.Scorer) -> DataFrame:
    """A master list updated from validated data, whose LGA and ward names are first set to the reference's."""
    clean = M.standardize_names(validated, reference.select("state", "lga").distinct(), "lga", "lga", ["state"], S.ADMIN_CUTOFF, score)
    clean = M.standardize_names(clean, reference.select("state", "lga", "ward").distinct(), "ward", "ward", ["state", "lga"], S.ADMIN_CUTOFF, score)
    replace = [c for c in ("set_population", "set_target", "team_code", "day_of_activity") if c in clean.columns and c in master.columns]
    append = [c for c in ("comment",) if c in clean.columns and c in master.columns]
    fill = [c for c in ("take_off_point",) if c in clean.columns and c in master.columns]
    first = L.keep_first(clean.select(*key, *replace, *append, *fill), key, [F.struct(*(F.col(c) for c in (*replace, *append, *fill)))])
    return L.update_from(master, first, key, replace, append, fill)


def repair_population(df: DataFrame) -> DataFrame:
    """Populations, targets and households repaired where they are flagged."""
    total, target, hh = F.col("set_population"), F.col("set_target"), F.col("number_of_household")
    flagged = df.withColumn("_wp", R.population_flag(total, target)).withColumn("_wh", R.household_flag(hh, target, total))
    flagged = flagged.withColumns(
        {
            "set_population": R.repaired_population(total, target, F.col("_wp")),
            "set_target": R.repaired_target(total, target, F.col("_wp")),
            "number_of_household": R.repaired_households(hh, target, total, F.col("_wh")),
        }
    )
    return flagged.drop("_wp", "_wh")


def fix_global_ids(df: DataFrame, column: str = "eha_guid") -> DataFrame:
    """Missing or malformed ids replaced by new ones (not the same from run to run)."""
    df = df if column in df.columns else df.withColumn(column, F.lit(None).cast("string"))
    good = F.coalesce(X.is_uuid(F.col(column)), F.lit(False))
    return df.withColumn(column, F.when(good, F.col(column)).otherwise(F.replace(F.uuid(), F.lit("-"), F.lit(""))))


def post_report(df: DataFrame, level: list[str], status: str, labels: tuple[str, ...]) -> DataFrame:
    """Counts in label order with a total row."""
    return A.with_total_row(A.crosstab(df, level, status, labels, "total"), level[-1]) if len(level) == 1 else A.crosstab(df, level, status, labels, "total")


def deep_duplicates(df: DataFrame, block: list[str], key: str, name: str, score: M.Scorer, distance: Callable[[str, str], Column]) -> DataFrame:
    """The list with the strongest duplicate action of each settlement."""
    pairs = M.duplicate_pairs(df.select(*block, key, name, "x", "y"), block, key, name, S.DUPLICATE_NAME_SCORE, score, distance)
    return df.join(M.worst_action(pairs, key), key, "left")
