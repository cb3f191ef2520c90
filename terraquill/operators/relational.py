"""Row selection, keys, joins and set operations on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.operators.graph import cut_lineage


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key, the first in the given order, by a partial aggregate rather than a sort."""
    columns = df.columns
    first = df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    return first.select(*(F.col(f"_first.{c}").alias(c) for c in columns))


def duplicate_flag(df: DataFrame, columns: list[str], label: str, name: str | None = None, ignore_nulls: bool = False) -> DataFrame:
    """Labels all rows whose columns occur more than once, nulls equal to each other; ``ignore_nulls``: only where none of them is null. Keys are
    counted with partial sums and only those that occur twice are joined back, so that rows without a value meet nowhere."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)) if ignore_nulls else F.lit(True)
    keys = [f"_dup{k}" for k in range(len(columns))]
    counts = df.where(known).groupBy(*(F.col(c).alias(k) for c, k in zip(columns, keys))).agg(F.count(F.lit(1)).alias("_dup_n")).where("_dup_n > 1")
    same = (lambda a, b: a == b) if ignore_nulls else (lambda a, b: a.eqNullSafe(b))
    on = reduce(lambda a, b: a & b, (same(F.col(c), F.col(k)) for c, k in zip(columns, keys)))
    flagged = df.join(counts, on, "left").withColumn("_dup_label", F.when(F.col("_dup_n").isNotNull(), label))
    return flagged.select(*(F.col(c) for c in df.columns if c != (name or label)), F.col("_dup_label").alias(name or label))


def any_in_group(df: DataFrame, key: list[str], condition: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.bool_or(condition).over(Window.partitionBy(*key)))


def row_ids(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Row numbers from 1 in a global order of keys of any type, without a global window: rows are dealt to ranges of the whole
    order, by its quantiles, and sorted there; each range starts where the counts of those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)  # a lost task must not be dealt to other ranges
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each partition
    placed = ranged.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_at", "_start")


def running_ranges(df: DataFrame, partition: list[str], order: list[Column], amount: str) -> DataFrame:
    """``low`` and ``high``: successive ranges of ``amount`` numbers in each partition."""
    high = F.sum(amount).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("high", high).withColumn("low", F.col("high") - F.col(amount) + 1)


def letter_suffix(df: DataFrame, key: list[str], order: list[Column], name: str = "suffix") -> DataFrame:
    """A, B, C ... within each key, A again after Z."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn(name, F.char(65 + k % 26))


def single_value_fill(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Where a group has exactly one distinct value, all of its rows get it."""
    w = Window.partitionBy(*key)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(column, F.when(low == high, low).otherwise(F.col(column)))


def drop_unless_whole_group(df: DataFrame, key: list[str], droppable: Column) -> DataFrame:
    """Without the droppable rows, but for groups in which all are."""
    all_ = F.bool_and(droppable).over(Window.partitionBy(*key))
    return df.withColumn("_all", all_).where(F.col("_all") | ~droppable).drop("_all")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_source(frames: dict[str, DataFrame], name: str = "source") -> DataFrame:
    return union_all([df.withColumn(name, F.lit(k)) for k, df in frames.items()])


def exists_in(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """Adds whether the key occurs in ``other``; rows never multiply."""
    hits = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(hits, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def membership_errors(df: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    return df.join(allowed, on, "left_anti")


def fallback_join(base: DataFrame, other: DataFrame, keys: list[str], row_id: str, value_columns: list[str]) -> DataFrame:
    """Left joins on each key in turn; ``matches``: the struct of values found by each, in key order.

    The other side is reduced to its first row per key (by the value columns) before each join.
    """
    out = base
    for k in keys:
        first = keep_first(other.where(F.col(k).isNotNull()).select(k, *value_columns), [k], [F.col(c) for c in value_columns])
        out = out.join(first.select(k, F.struct(*value_columns).alias(f"_by_{k}")), k, "left")
    found = F.array(*(F.col(f"_by_{k}") for k in keys))
    return out.withColumn("matches", found).drop(*(f"_by_{k}" for k in keys))


def update_from(base: DataFrame, other: DataFrame, on: list[str], replace: list[str], append: list[str], fill: list[str]) -> DataFrame:
    """Left join for an update: ``replace`` takes the new value if there is one, ``append`` joins both by a colon,
    ``fill`` keeps the old value if there is one."""
    new = other.select(*on, *(F.col(c).alias(f"_new_{c}") for c in (*replace, *append, *fill)))
    joined = base.join(new, on, "left")
    changed = {c: F.coalesce(f"_new_{c}", c) for c in replace}
    changed |= {c: F.nullif(F.concat_ws(":", c, f"_new_{c}"), F.lit("")) for c in append}
    changed |= {c: F.coalesce(c, f"_new_{c}") for c in fill}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in base.columns))


def suffix_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, delimiter: str = "_") -> DataFrame:
    """Pairs in which the left name ends with the right one at a delimiter, where both have exactly one partner.

    Every suffix of a left name is a row, so that the pairing is an equality join.
    """
    parts = F.split(left_name, delimiter)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), delimiter)
    )
    pairs = left.withColumn("_suffix", F.explode(suffixes)).join(right, F.col("_suffix") == F.col(right_name))
    one_left = F.count("*").over(Window.partitionBy(left_name)) == 1
    one_right = F.count("*").over(Window.partitionBy(right_name)) == 1
    return pairs.withColumn("_l", one_left).withColumn("_r", one_right).where("_l and _r").drop("_suffix", "_l", "_r")


def dataset_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, column, old, new): added and removed rows, and each changed cell; comparison is null-safe."""
    a = old.select(F.col(key).alias("_k"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_old"))
    b = new.select(F.col(key).alias("_k"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_new"))
    both = a.join(b, "_k", "full_outer")
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(f"_old.{c}").alias("old"), F.col(f"_new.{c}").alias("new")) for c in columns)
    )
    changed = F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("column"), none.alias("old"), none.alias("new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    rows = both.select(F.col("_k").alias(key), change.alias("change"), F.explode(F.when(change == "changed", changed).otherwise(whole)).alias("c"))
    return rows.select(key, "change", "c.column", "c.old", "c.new")


def key_set_sizes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: distinct keys in both, only in a, only in b."""
    x = a.select(*key).distinct().withColumn("_a", F.lit(1))
    y = b.select(*key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )
