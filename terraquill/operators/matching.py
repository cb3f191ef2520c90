"""Fuzzy joins: only distinct names meet, block by block, and the result is a mapping table.

Names are compared by a score that counts edits (``EditScorer``) only where they can reach the cutoff: the edits it allows spoil
at most k of a name's distinct letter pairs, so of the letter pairs in one order, the rarest first, two such names share one
among the first k + 1 of each. The join is on the block and these. Names with no more than k letter pairs meet by their lengths.
Other scores (best partial stretch, shared words) give no such bound: with them all distinct names of a block meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.functions import fuzzy
from terraquill.functions import rules as R
from terraquill.functions import text as T

Scorer = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class EditScorer:
    """A score of the edits between two names' keys: 100 less their share of the longer name's length, or, if only letters put in
    and left out count (``indel``), of both lengths. ``slack``: by how much rounding may raise it."""

    score: Scorer
    key: Callable[[Column], Column]
    indel: bool
    slack: float

    def __call__(self, a: Column, b: Column) -> Column:
        return self.score(a, b)

    def longest(self, cutoff: float, n: Column) -> Column:
        """The greatest length of a name that can reach the cutoff with one of n letters."""
        c = (cutoff - self.slack) / 100
        return F.floor(n * ((2 - c) / c if self.indel else 1 / c) + 1e-6)

    def spoilt(self, cutoff: float, n: Column) -> Column:
        """The most letter pairs that a name of n letters lacks in any that can reach the cutoff with it: two for each letter changed
        or left out, one for each put in."""
        c = (cutoff - self.slack) / 100
        if not self.indel:
            return 2 * F.floor((1 - c) * self.longest(cutoff, n) + 1e-6)
        # n - s letters are left out and m - s put in, where s, the letters kept, are c * (n + m) / 2 or more.
        m = c / (2 - c) if c > 2 / 3 else (2 - c) / c
        return F.floor(n * (2 + m - 1.5 * c * (1 + m)) + 1e-6)


def scorer(name: str) -> Scorer:
    score = lambda a, b: fuzzy.score(name, a, b)
    keys = {"ratio": lambda c: c, "token_sort_ratio": fuzzy.sorted_tokens}
    return EditScorer(score, keys[name], True, 0.5) if name in keys else score


#: Score by plain edits, to six places.
LEVENSHTEIN = EditScorer(lambda a, b: F.round(fuzzy.levenshtein_score(a, b), 6), lambda c: c, False, 1e-6)


def _edit_pairs(a: DataFrame, b: DataFrame, block: list[str], x: str, y: str, cutoff: float, score: EditScorer) -> DataFrame:
    """The pairs of names (block, x, y) that can reach the cutoff, each once."""
    named = lambda df, c, side: df.select(*block, F.col(c).alias("_name"), F.lit(side).alias("_side"))
    both = named(a, x, 0).unionByName(named(b, y, 1)).withColumn("_key", score.key(F.col("_name")))
    n = F.length("_key")
    pieces = F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.col("_key").substr(k, F.lit(2)))))
    both = both.select(*block, "_name", "_side", n.alias("_letters"), F.coalesce(pieces, F.array().cast("array<string>")).alias("_pieces"))
    both = both.withColumn("_spoilt", score.spoilt(cutoff, F.col("_letters")))
    rows = both.select(*block, "_name", "_side", "_spoilt", F.explode("_pieces").alias("_piece"))
    freq = rows.groupBy(*block, "_piece").agg(F.count("*").alias("_freq"))
    order = Window.partitionBy(*block, "_side", "_name").orderBy("_freq", "_piece")
    first = rows.join(freq, [*block, "_piece"]).withColumn("_rank", F.row_number().over(order)).where("_rank <= _spoilt + 1")
    side = lambda df, k, c: df.where(F.col("_side") == k).withColumnRenamed("_name", c).drop("_side")
    keep = [*block, "_name", "_side", "_piece"]
    meet = side(first.select(*keep), 0, x).join(side(first.select(*keep), 1, y), [*block, "_piece"])
    # Where letter pairs prove nothing on either side.
    few = both.where(F.size("_pieces") <= F.col("_spoilt")).select(*block, "_name", "_side", "_letters")
    reach = side(few, 0, x).withColumn("_letters", F.explode(F.sequence(F.lit(0).cast("long"), score.longest(cutoff, F.col("_letters")))))
    short = reach.withColumn("_letters", F.col("_letters").cast("int")).join(side(few, 1, y), [*block, "_letters"])
    return meet.select(*block, x, y).unionByName(short.select(*block, x, y)).distinct()


def _pairs(a: DataFrame, b: DataFrame, block: list[str], x: str, y: str, cutoff: float, score: Scorer) -> DataFrame:
    if isinstance(score, EditScorer) and cutoff - score.slack > 0:
        return _edit_pairs(a, b, block, x, y, cutoff, score)
    return a.join(b, block)


def mapping(names: DataFrame, reference: DataFrame, name: str, ref_name: str, block: list[str], cutoff: float, score: Scorer) -> DataFrame:
    """(block, name, match, score): for each distinct name of a block, the best reference name of the block that
    reaches the cutoff, ties to the smaller name. Exact matches skip the scorer."""
    a = names.where(F.col(name).isNotNull()).select(*block, F.col(name).alias("_n")).distinct()
    b = reference.where(F.col(ref_name).isNotNull()).select(*block, F.col(ref_name).alias("_r")).distinct()
    exact = a.join(b, [F.col("_n") == F.col("_r"), *(a[c].eqNullSafe(b[c]) for c in block)], "left_semi")
    exact = exact.select(*block, "_n", F.col("_n").alias("match"), F.lit(100.0).alias("score"))
    rest = a.join(exact.select(*block, "_n"), [*block, "_n"], "left_anti")
    pairs = _pairs(rest, b, block, "_n", "_r", cutoff, score).withColumn("score", score(F.col("_n"), F.col("_r"))).where(F.col("score") >= cutoff)
    best = pairs.groupBy(*block, "_n").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_r").alias("r"))).alias("_b"))
    return exact.unionByName(best.select(*block, "_n", F.col("_b.r").alias("match"), (-F.col("_b.s")).alias("score"))).withColumnRenamed("_n", name)


def standardize_names(df: DataFrame, reference: DataFrame, name: str, ref_name: str, block: list[str], cutoff: float, score: Scorer) -> DataFrame:
    """The rows with their names replaced by the best reference names; those without a match keep theirs."""
    table = mapping(df, reference, name, ref_name, block, cutoff, score).select(*block, name, "match")
    return df.join(table, [*block, name], "left").withColumn(name, F.coalesce("match", name)).drop("match").select(*df.columns)


def duplicate_pairs(df: DataFrame, block: list[str], key: str, name: str, cutoff: float, score: Scorer, distance: Callable[[str, str], Column]) -> DataFrame:
    """Unordered pairs of a block with the same or similar names: key_a, key_b, score, metres, action.

    Names are scored once for each distinct pair of a block. A similar pair doesn't count if either name ends in a letter or digit of its own.
    ``distance``: metres from the two sides' column prefixes.
    """
    names = df.select(*block, name).where(F.col(name).isNotNull()).distinct()
    a, b = names.withColumnRenamed(name, "name_a"), names.withColumnRenamed(name, "name_b")
    plain = lambda c: ~T.has_suffix(F.col(c))
    scored = _pairs(a.where(plain("name_a")), b.where(plain("name_b")), block, "name_a", "name_b", cutoff, score).where("name_a < name_b")
    scored = scored.withColumn("score", score(F.col("name_a"), F.col("name_b"))).where(F.col("score") >= cutoff)
    same = names.select(*block, F.col(name).alias("name_a"), F.col(name).alias("name_b"), F.lit(100.0).alias("score"))
    kinds = scored.unionByName(same)
    left = df.select(*block, *(F.col(c).alias(f"{c}_a") for c in df.columns if c not in block))
    right = df.select(*block, *(F.col(c).alias(f"{c}_b") for c in df.columns if c not in block))
    kinds = kinds.withColumnsRenamed({"name_a": f"{name}_a", "name_b": f"{name}_b"})
    pairs = left.join(kinds, [*block, f"{name}_a"]).join(right, [*block, f"{name}_b"])
    one_way = (F.col(f"{name}_a") != F.col(f"{name}_b")) | (F.col(f"{key}_a") < F.col(f"{key}_b"))
    metres = F.round(distance("_a", "_b"), 3)
    return pairs.where(one_way).withColumn("metres", metres).select(
        *block, f"{key}_a", f"{key}_b", f"{name}_a", f"{name}_b", "score", "metres", R.duplicate_action(F.col("metres")).alias("action")
    )


def worst_action(pairs: DataFrame, key: str) -> DataFrame:
    """(key, action): the strongest action of the pairs that each settlement is in: remove, review, potential."""
    rank = (
        F.when(F.col("action") == "Duplicate Remove", F.struct(F.lit(2), F.lit("remove")))
        .when(F.col("action") == "Duplicate Review", F.struct(F.lit(1), F.lit("review")))
        .otherwise(F.struct(F.lit(0), F.lit("potential")))
    )
    each = pairs.select(F.explode(F.array(f"{key}_a", f"{key}_b")).alias(key), rank.alias("_r"))
    return each.groupBy(key).agg(F.max("_r").alias("_r")).select(key, F.col("_r.col2").alias("action"))
