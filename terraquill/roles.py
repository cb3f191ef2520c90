"""Roles: which physical column of a table plays which part. Resolution is driver-side work on names; only the checks
that look at values run one aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraquill import settings as S
from terraquill.functions import fuzzy
from terraquill.functions import text as X


class DataError(ValueError):
    """Input that lacks what an operator needs."""


class NotFoundError(DataError):
    """No column plays a role that is required."""


@dataclass(frozen=True)
class Coordinates:
    latitude: str | None
    longitude: str | None

    @property
    def found(self) -> bool:
        return bool(self.latitude and self.longitude)


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


@dataclass(frozen=True)
class Profile:
    """What the values of a table's columns are like, from one aggregate: everything that binding looks at is read from it.

    ``decimals``: floating columns that have some value of two decimals or more. ``least_underscores``: of string columns, the fewest underscores of a value (0
    for a null); ``uuids``: the share of rows that are UUIDs; ``visits``: whether all values are visit labels; ``rounds``: whether the column has values and all are round labels.
    """

    columns: tuple[str, ...]
    decimals: frozenset[str]
    least_underscores: dict[str, int]
    uuids: dict[str, float]
    visits: frozenset[str]
    rounds: frozenset[str]

    def coordinates(self, required: bool = False) -> Coordinates:
        return _coordinate_roles([c for c in self.columns if c in self.decimals], required)

    def unique_column(self) -> str | None:
        return next((c for c in self.columns if self.least_underscores.get(c, 0) >= 2), None)

    def uuid_column(self, share: float = 0.6) -> str | None:
        return next((c for c in self.columns if self.uuids.get(c, 0) >= share), None)

    def visitation_column(self) -> str | None:
        return next((c for c in reversed(self.columns) if c in self.visits), None)

    def round_columns(self, exclude: tuple[str, ...] = ()) -> list[str]:
        skipped = {c.lower() for c in (*exclude, *S.NEVER_ROUNDS)}
        return [c for c in self.columns if c in self.rounds and c.lower() not in skipped]


def profile(df: DataFrame) -> Profile:
    """One pass over the table, partial sums only; of an empty table nothing is known."""
    texts, floats = _strings(df), [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    at = lambda c: F.col(f"`{c}`")
    value = lambda c: F.nullif(F.lower(F.trim(at(c))), F.lit(""))
    decimal = lambda c: at(c).cast("string").rlike(S.STRICT_COORDINATE)
    wanted = {("rows", ""): F.count("*")}
    wanted |= {("decimal", c): F.bool_or(decimal(c)) for c in floats}
    for c in texts:
        wanted |= {
            ("underscores", c): F.min(F.coalesce(F.regexp_count(at(c), F.lit("_")), F.lit(0))),
            ("uuid", c): F.avg(F.coalesce(X.is_uuid(at(c)), F.lit(False)).cast("int")),
            ("visit", c): F.bool_and(F.coalesce(F.initcap(at(c)).isin(*S.VISIT_ORDER), F.lit(False))),
            ("round", c): F.bool_and(value(c).isin(*S.ROUND_LABELS)),
        }
    row = df.agg(*(v.alias(f"_{k}") for k, v in enumerate(wanted.values()))).first()
    found = {name: row[k] for k, name in enumerate(wanted)}
    of = lambda kind: {c: v for (k, c), v in found.items() if k == kind and v is not None}
    true = lambda kind: frozenset(c for c, v in of(kind).items() if v)
    return Profile(tuple(df.columns), true("decimal"), of("underscores"), of("uuid"), true("visit"), true("round"))


def admin_column(df: DataFrame, role: str, required: bool = True) -> str | None:
    """The column of an admin level: of the five most similar names, without code, old or id columns, the first that
    holds the role's name nearly whole."""
    names = [c for c in df.columns if not re.search(r"(?i)(code|old|id$|_id_)", c)]
    ranked = sorted(names, key=lambda c: (-fuzzy.weighted_ratio(role, c), df.columns.index(c)))[:5]
    for c in ranked:
        if fuzzy.weighted_ratio(role, c) >= S.ADMIN_CUTOFF and fuzzy.partial_ratio(role.lower(), c.lower()) >= S.ADMIN_PARTIAL:
            return c
    if required:
        raise NotFoundError(f"no {role} column among {', '.join(df.columns)}")
    return None


def find_column(df: DataFrame, name: str, cutoff: float = S.COLUMN_CUTOFF, required: bool = False) -> str | None:
    found = fuzzy.best_match(name, df.columns, cutoff)
    if found is None and required:
        raise NotFoundError(f"no column like {name}")
    return found


def with_column_like(df: DataFrame, name: str) -> DataFrame:
    """The table with the named role present: null if no column is like it."""
    return df if find_column(df, name) else df.withColumn(name, F.lit(None).cast("string"))


def bind(df: DataFrame, roles: tuple[str, ...], cutoff: float = S.ATTRIBUTE_CUTOFF) -> dict[str, str]:
    """Role to column for every role that some column is like."""
    found = {r: fuzzy.best_match(r, df.columns, cutoff) for r in roles}
    return {r: c for r, c in found.items() if c}


def _coordinate_roles(floats: list[str], required: bool) -> Coordinates:
    def one(role: str, short: str) -> str | None:
        exact = [c for c in floats if c.lower() in (role, short, role[:3])]
        return exact[0] if exact else fuzzy.best_match(role, floats, 85)

    found = Coordinates(one("latitude", "y"), one("longitude", "x"))
    if not found.found and (required or found.latitude or found.longitude):
        missing = "latitude" if not found.latitude else "longitude"
        raise NotFoundError(f"no {missing} column of decimal numbers")
    return found


def coordinates(df: DataFrame, required: bool = False) -> Coordinates:
    """Floating-point columns named like latitude or y and longitude or x, by their types alone; ``Profile.coordinates`` looks at their values too."""
    return _coordinate_roles([f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))], required)


def unique_column(df: DataFrame) -> str | None:
    """The first string column without nulls whose every value has two underscores or more; one aggregate."""
    names = _strings(df)
    if not names:
        return None
    good = df.agg(
        *(F.min(F.coalesce(F.regexp_count(F.col(c), F.lit("_")), F.lit(0))).alias(f"_{k}") for k, c in enumerate(names))
    ).first()
    return next((c for k, c in enumerate(names) if (good[k] or 0) >= 2), None)


def with_unique_column(df: DataFrame, name: str = "unique_code") -> tuple[DataFrame, str]:
    """The table with a key column: the one it has, or one built from the admin columns."""
    found = unique_column(df)
    if found:
        return df, found
    parts = [F.col(admin_column(df, r)) for r in ("state", "lga", "ward", "settlement")]
    return df.withColumn(name, X.unique_key(*parts)), name


def uuid_column(df: DataFrame, share: float = 0.6) -> str | None:
    """The first string column of which at least this share of the rows are UUIDs."""
    names = _strings(df)
    if not names:
        return None
    found = df.agg(*(F.avg(F.coalesce(X.is_uuid(F.col(c)), F.lit(False)).cast("int")).alias(f"_{k}") for k, c in enumerate(names))).first()
    return next((c for k, c in enumerate(names) if (found[k] or 0) >= share), None)


def visitation_column(df: DataFrame, labels: tuple[str, ...] = S.VISIT_ORDER) -> str | None:
    """The last string column without nulls whose values are all visit labels."""
    names = _strings(df)
    if not names:
        return None
    found = df.agg(*(F.bool_and(F.coalesce(F.initcap(F.col(c)).isin(*labels), F.lit(False))).alias(f"_{k}") for k, c in enumerate(names))).first()
    good = [c for k, c in enumerate(names) if found[k]]
    return good[-1] if good else None


def day_column(columns: list[str], day: int) -> str | None:
    """The first column that names the day: the word, then the number; cumulative columns don't count."""
    for c in columns:
        m = re.search(r"(?i)day\D*(\d+)", c)
        if m and int(m[1]) == day and "cum" not in c.lower():
            return c
    return None


def day_word_column(columns: list[str]) -> str:
    """The first column whose name has the word Day."""
    for c in columns:
        if re.search(r"(?i)\bday\b", c):
            return c
    raise NotFoundError("no column names a day of activity")


def keyword_column(columns: list[str], keywords: tuple[str, ...], skip_codes: bool = False) -> str | None:
    """The column of the best score: a keyword (100), its plural (95) or a name that holds it (60), less by one for each
    keyword further on; ties to the first column. ``skip_codes``: code, old and id columns don't count."""

    def score(c: str) -> int:
        name = c.lower().strip()
        if skip_codes and re.search(r"(code|old|id$|_id_)", name):
            return 0
        whole = [best - k for k, w in enumerate(keywords) for best, form in ((100, w), (95, f"{w}s")) if name == form]
        return whole[0] if whole else max((60 - k for k, w in enumerate(keywords) if w in name), default=0)

    best = max(columns, key=score, default=None)
    return best if best is not None and score(best) > 0 else None


def round_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """String columns with some value whose values are all round labels, in the table's order; one aggregate."""
    skipped = {c.lower() for c in (*exclude, *S.NEVER_ROUNDS)}
    names = [c for c in _strings(df) if c.lower() not in skipped]
    if not names:
        return []
    value = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    found = df.agg(*(F.bool_and(value(c).isin(*S.ROUND_LABELS)).alias(f"_{k}") for k, c in enumerate(names))).first()
    return [c for k, c in enumerate(names) if found[k]]


def ranked(columns: list[str], ranking: list[int] | None = None) -> list[str]:
    """Grouping columns from the highest rank to the lowest; as they are without a ranking."""
    if not ranking:
        return list(columns)
    if len(ranking) != len(columns):
        raise DataError("as many ranks as columns are needed")
    return [c for c, _ in sorted(zip(columns, ranking), key=lambda x: -x[1])]


def align(left: DataFrame, right: DataFrame, roles: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    """Role to the pair of columns that play it in both tables."""
    a, b = bind(left, roles), bind(right, roles)
    return {r: (a[r], b[r]) for r in roles if r in a and r in b}
