"""Text functions: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraquill import settings as S

_LETTER_EDGE = r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, wherever it stands (``initcap`` only looks at white space)."""
    runs = F.split(F.lower(c), _LETTER_EDGE)
    return F.array_join(F.transform(runs, F.initcap), "")


def standardize(c: Column) -> Column:
    """Trimmed, title case, white space collapsed; empty becomes null."""
    return F.nullif(F.regexp_replace(title_case(F.trim(c)), r"\s+", " "), F.lit(""))


def standard_column_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip()).lower()


def expand_abbreviations(c: Column, words: dict[str, str] | None = None) -> Column:
    """Known short forms, as whole words in any case and with or without a dot, written out."""
    for short, full in (words or S.ABBREVIATIONS).items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b\.?", full)
    return c


def unique_key(*parts: Column) -> Column:
    """``State_Lga_Ward_Settlement``: null as soon as a part is."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws("_", *(title_case(F.trim(p)) for p in parts)))


def takeoff_name(c: Column) -> Column:
    """Facility names in short form, the facility word moved to the end and in its own spelling."""
    for short, full in S.FACILITIES.items():
        c = F.regexp_replace(c, full, short)
    word = "(?:" + "|".join(S.FACILITY_WORDS) + ")"
    found = F.regexp_extract(c, rf"(?i)(?:\btown\b\s+)?{word}(?:\s+office\s+)?(?:\s+[A-Za-z0-9])?\b", 0)
    moved = F.when((found == "") | c.endswith(found), c).otherwise(
        F.concat(F.trim(F.replace(c, found, F.lit(""))), F.lit(" "), found)
    )
    for w in S.FACILITY_WORDS:
        moved = F.regexp_replace(moved, rf"(?i)\b{w}\b", w)
    return moved


def delimited_days(c: Column) -> Column:
    """Day lists with ``_`` between the days."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s*[,;&/\s]\s*", "_")


def clean_team_codes(c: Column) -> Column:
    return F.regexp_replace(c, "[&,_/]", ";")


def team_codes(c: Column) -> Column:
    """The team codes of a cell: an array, trimmed, padded with zeros to three places."""
    return F.transform(
        F.split(clean_team_codes(c), ";"),
        lambda x: F.when(F.length(F.trim(x)) < 3, F.lpad(F.trim(x), 3, "0")).otherwise(F.trim(x)),
    )


def digits(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d)"), F.lit(1))


def activity_days(c: Column, days: int = 4) -> Column:
    """``Day 1, 2``: the distinct days up to ``days`` that the text names, in order; null if none."""
    kept = F.array_sort(F.array_distinct(F.filter(digits(c), lambda d: d.cast("int") <= days)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("Day "), F.array_join(kept, ", ")))


def day_flags(c: Column, days: int) -> list[Column]:
    """Columns ``Day 1`` ...: Yes if the day is named, else null."""
    return [F.when(F.array_contains(digits(c), str(k)), "Yes").alias(f"Day {k}") for k in range(1, days + 1)]


def last_segment(c: Column, delimiter: str = "_") -> Column:
    return F.element_at(F.split(c, re.escape(delimiter)), -1)


def has_suffix(c: Column) -> Column:
    """Whether the name ends in a single letter or digit of its own."""
    return c.rlike(r"(?i)\b([A-Z]|[1-9])$")


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("long")


def is_uuid(c: Column) -> Column:
    """A version 4 UUID, with dashes or as 32 hexadecimal digits."""
    low = F.lower(F.trim(c))
    return low.rlike(S.UUID4) | low.rlike("^[0-9a-f]{32}$")


def sheet_name(c: Column) -> Column:
    return F.substring(F.translate(c, "/_", "- "), 1, 31)


def coord_id(lat: Column, lon: Column, places: int = 6) -> Column:
    """Coordinates as one text key, with a fixed number of places."""
    return F.concat_ws("_", *(c.cast(f"decimal(18,{places})").cast("string") for c in (lat, lon)))


def fold_category(c: Column, categories: tuple[str, ...]) -> Column:
    """The category that the value spells in any case and with any white space around it; else null."""
    out = F.lit(None).cast("string")
    for name in reversed(categories):
        out = F.when(F.lower(F.trim(c)) == name.lower(), name).otherwise(out)
    return out


def parse_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("MM/dd/yyyy HH:mm:ss"))


def delimiter_count(c: Column, delimiter: str = "_") -> Column:
    return F.regexp_count(c.cast("string"), F.lit(re.escape(delimiter)))


def team_code_over_limit(c: Column) -> Column:
    """Whether the code is a number above the limit."""
    return F.coalesce(c.try_cast("bigint") > S.TEAM_CODE_LIMIT, F.lit(False))


def team_plan_name(c: Column) -> Column:
    """Team, ward and LGA of a team's plan file, null if the name has another form."""
    form = r"(?i)^DIP of Team (\S+) (.+?) ward, (.+) LGA\.pdf$"
    part = lambda k, name: F.regexp_extract(c, form, k).alias(name)
    return F.when(c.rlike(form), F.struct(part(1, "team"), part(2, "ward"), part(3, "lga")))


def lga_plan_name(c: Column) -> Column:
    """LGA of a plan file and the part of its name that pages are matched by, null if the name has another form."""
    form = r"^DIP of .*?,\s*(.+?)\s+(?i:LGA\.pdf)$"
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).alias("lga"), F.substring(c, 8, 2**31 - 1).alias("id")))
