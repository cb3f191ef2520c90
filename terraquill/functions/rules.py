"""Row rules of the domain: CASE logic as Column builders. A flag is null where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraquill import settings as S


def empty_number(c: Column) -> Column:
    """Null, NaN or zero."""
    return F.coalesce(F.isnan(c.cast("double")) | (c == 0), F.lit(True))


def empty_text(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


# --- visits -------------------------------------------------------------------------------------------------


def visited(*statuses: Column) -> Column:
    """Visited once any of the statuses is; else not yet."""
    any_ = reduce(Column.__or__, (F.coalesce(s == S.VISITED, F.lit(False)) for s in statuses))
    return F.when(any_, S.VISITED).otherwise(S.NOT_YET_VISITED)


def day_status(day: Column, cumulative: Column) -> Column:
    """A planned day takes the cumulative status; one that isn't planned stays null."""
    return F.when(day.isNotNull(), cumulative)


def planned_so_far(*days: Column) -> Column:
    return F.coalesce(*days).isNotNull()


def mop_up(status: Column) -> Column:
    """On the last day, what isn't visited yet won't be."""
    return F.when(status == S.NOT_YET_VISITED, S.NOT_VISITED).otherwise(status)


def coverage_class(ratio: Column, strict: bool = False) -> Column:
    """The class of a share of visited cells, rounded to two places. ``strict``: a share that rounds to 0 without
    being 0 counts as full, as the tables it is held against have it."""
    r = F.bround(ratio, 2)
    none = F.when(empty_number(ratio), S.NO_COVERAGE)
    if strict:
        none = none.when(r < 0.01, S.FULL)
    return none.when(r < 0.5, S.POOR).when(r < 0.7, S.PARTIAL).otherwise(S.FULL)


def time_spent_class(minutes: Column) -> Column:
    return (
        F.when(empty_number(minutes), F.lit(None))
        .when(minutes.between(1, 12), "<12 mins")
        .when(minutes.between(13, 30), "12 - 30 mins")
        .when(minutes.between(31, 60), "30 mins - 1 hr")
        .when(minutes.between(61, 120), "1 - 2 hrs")
        .otherwise(">2 hrs")
    )


def final_coverage(current: Column, previous: Column) -> Column:
    return F.greatest(current, previous)


def needs_reassessment(status: Column, area: Column, tracks: Column) -> Column:
    """A visit with too few track points for its area."""
    enough = F.when(area >= 10_000, tracks >= 30).otherwise(tracks >= 15)
    return (status == S.VISITED) & ~enough


# --- entries -----------------------------------------------------------------------------------------------


def name_length_flag(name: Column) -> Column:
    return (
        F.when(name.isNull(), "no settlement name")
        .when(F.length(F.trim(name)) < 3, "invalid name length")
        .when(F.size(F.split(F.trim(name), " ")) >= 10, "review settlement name")
    )


def missing_coordinates_flag(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNull() | lon.isNull(), "No Coordinates")


def valid_coordinate(c: Column, strict: bool = False) -> Column:
    """A number within the range of degrees; ``strict``: text with two decimals or more, starting with a digit."""
    if strict:
        return c.cast("string").rlike(S.STRICT_COORDINATE)
    return F.coalesce(F.abs(c.try_cast("double")) <= 180, F.lit(False))


def numeric_entry_flag(c: Column, allow_zero: bool = False, numeric: bool = False) -> Column:
    """Text that does not start with a digit. ``numeric``: the column holds numbers, which are all right whatever their sign."""
    if allow_zero or numeric:
        return F.lit(None).cast("string")
    return F.when(~c.cast("string").rlike(r"^\d+"), "Wrong Entry")


def population_flag(total: Column, target: Column) -> Column:
    return (
        F.when(total.isNull() & target.isNull(), F.lit(None))
        .when((total == 0) & (target == 0), F.lit(None))
        .when(total.isNull() | target.isNull(), "Missing total/target Population Entry")
        .when(target >= total, "Invalid Population Entry")
    )


def household_flag(household: Column, target: Column, total: Column) -> Column:
    children, people = F.bround(target / household, 0), F.bround(total / household, 0)
    return (
        F.when(household.isNull() & target.isNull() & total.isNull(), F.lit(None))
        .when((household == 0) & (target == 0) & (total == 0), F.lit(None))
        .when(empty_number(household) & (target.isNotNull() | total.isNotNull()), "Missing Settlement Household")
        .when(children > 15, F.concat(children.cast("long").cast("string"), F.lit(" children per household should be reviewed")))
        .when(people > 40, F.concat(people.cast("long").cast("string"), F.lit(" people per household should be reviewed")))
    )


def preset_flag(c: Column, options: tuple[str, ...]) -> Column:
    return F.when(c.isNotNull() & ~c.cast("string").isin(*options), "Invalid Entry")


def missing_reason_flag(reason: Column, accessibility: Column) -> Column:
    return F.when(
        reason.isNull() & accessibility.isNotNull() & (F.initcap(accessibility) != S.FULLY_ACCESSIBLE),
        "Missing Reason for Inaccessibility Entry",
    )


def habitation_flag(compromised: Column, accessibility: Column, reason: Column) -> Column:
    """Whether security, accessibility and its reason agree."""
    full = accessibility == S.FULLY_ACCESSIBLE
    known = accessibility.isin(*S.PRESETS["accessibility_status"]) & compromised.isin(*S.YES_NO)
    return (
        F.when(compromised.isNull() | accessibility.isNull(), F.lit(None))
        .when(~known, "Invalid Entry")
        .when((compromised == "Y") & full, F.concat(F.lit("Cannot be security compromised and "), accessibility))
        .when((compromised == "N") & ~full, F.concat(F.lit("Cannot be "), accessibility, F.lit(" accessibility and not security compromised")))
        .when((compromised == "Y") & reason.isNull(), "Reason for Security Compromised not Provided")
        .when(
            reason.isNotNull() & full,
            F.concat(accessibility, F.lit(" settlement should not have "), reason, F.lit(" reason for inaccessibility")),
        )
    )


def settlement_type_flag(urban: Column, rural: Column, scattered: Column) -> Column:
    same = (urban == rural) & (rural == scattered)
    return F.when(same, F.concat(F.lit("urban, rural and scattered cannot have the same "), rural, F.lit(" value"))).when(
        (urban == "Y") & (scattered == "Y"), "urban and scattered cannot be both be Y"
    )


def distance_class(metres: Column) -> Column:
    """Proximity label. The middle label of the scheme is never given: up to 20 m is the first, all else the last."""
    return F.when(metres.isNull(), F.lit(None)).when(metres <= 20, "Within 10m").otherwise("Within 30m")


def duplicate_action(metres: Column) -> Column:
    """What to do with two settlements of the same name at this distance."""
    return (
        F.when(metres.isNull(), "Duplicate Review")
        .when(metres > 65, "Unlikely Potential Duplicate Review")
        .when((metres > 10) & (metres < 65), "Duplicate Review")
        .otherwise("Duplicate Remove")
    )


# --- flags and status ----------------------------------------------------------------------------------------


def flagged(*issues: Column) -> Column:
    return F.when(F.coalesce(*issues).isNotNull(), "Flagged")


def flag_level(is_flagged: Column, *major: Column) -> Column:
    return F.when(is_flagged.isNull(), F.lit(None)).when(F.coalesce(*major).isNotNull(), "Major Flag").otherwise("Minor Flag")


def excluded(comment: Column, habitation: Column) -> Column:
    """A comment that tells the settlement is gone, or a status that does."""
    words = comment.rlike("(?i)" + "|".join(S.EXCLUSION_WORDS))
    return F.coalesce(words, F.lit(False)) | F.coalesce(habitation.isin(*S.GONE), F.lit(False))


def validation_status(is_invalid: Column, habitation: Column, is_flagged: Column, no_coordinates: Column) -> Column:
    return (
        F.when(F.coalesce(is_invalid, F.lit(False)) | F.coalesce(habitation.isin(*S.GONE), F.lit(False)), "Validated Unknown")
        .when(is_flagged.isNull(), "Validated")
        .when(no_coordinates.isNotNull(), "Not Validated")
        .otherwise("Validation Ongoing")
    )


def feedback(*issues: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *issues), F.lit(""))


# --- repairs -------------------------------------------------------------------------------------------------


def repaired_population(total: Column, target: Column, issue: Column) -> Column:
    return (
        F.when(issue.isNull(), total)
        .when(empty_number(total) & ~empty_number(target), F.bround(target / 0.2, 0))
        .when(target > 0.4 * total, F.bround(target / 0.2, 2))
        .otherwise(total)
    )


def repaired_target(total: Column, target: Column, issue: Column) -> Column:
    return F.when(issue.isNotNull() & ~empty_number(total) & empty_number(target), F.floor(total * 0.2).cast("double")).otherwise(target)


def repaired_households(household: Column, target: Column, total: Column, issue: Column) -> Column:
    return F.when(issue.isNull(), household).when(target >= 8, F.bround(target / 8, 0)).otherwise(F.bround(total / 10, 0))


def category_flags(category: Column) -> list[Column]:
    """urban, rural and scattered as Y or N from one category."""
    return [
        F.when(category.isNull(), F.lit(None)).when(F.lower(F.trim(category)) == k, "Y").otherwise("N").alias(k)
        for k in ("urban", "rural", "scattered")
    ]


# --- rounds --------------------------------------------------------------------------------------------------


def contact(rounds: list[Column]) -> tuple[Column, Column]:
    """How many rounds visited, and their share of the rounds that answered."""
    seen = reduce(Column.__add__, (F.coalesce((r == S.VISITED).cast("int"), F.lit(0)) for r in rounds))
    known = reduce(Column.__add__, (F.coalesce(r.isin(S.VISITED, S.NOT_VISITED).cast("int"), F.lit(0)) for r in rounds))
    return seen, F.when(known > 0, F.bround(seen / known, 2)).otherwise(F.lit(0.0))


def row_mode(values: list[Column], ignore: str = "Not Found") -> Column:
    """The most frequent value of a row, ties to the first; null if there is none."""
    a = F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ignore))
    ranked = F.transform(
        F.array_distinct(a),
        lambda v: F.struct(F.size(F.filter(a, lambda z: z == v)).alias("n"), (-F.array_position(a, v)).alias("p"), v.alias("v")),
    )
    return F.array_max(ranked)["v"]


def harmonized_visit(values: list[Column]) -> Column:
    return (
        F.when(F.coalesce(*values).isNull(), "Not Found")
        .when(F.exists(F.array(*values), lambda v: F.coalesce(v == S.VISITED, F.lit(False))), S.VISITED)
        .otherwise(S.NOT_VISITED)
    )


def harmonized_coverage(values: list[Column]) -> Column:
    """The best class among the matches; ``Not Found`` without any."""
    out = F.when(F.coalesce(*values).isNull(), "Not Found")
    for label in S.COVERAGE_ORDER:
        out = out.when(F.array_contains(F.array(*values), label), label)
    return out.otherwise(S.NO_COVERAGE)


def reach(sources: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Sources that hold a settlement, joined; how many; and whether there is any."""
    names = [F.when(hit, name) for name, hit in sources.items()]
    n = reduce(Column.__add__, (F.coalesce(hit, F.lit(False)).cast("int") for hit in sources.values()))
    return (
        F.nullif(F.concat_ws(" | ", *names), F.lit("")),
        n,
        F.when(n > 0, S.VISITED).otherwise(S.NOT_VISITED),
    )
