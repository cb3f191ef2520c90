"""Mixing sources to target weights by fitting each source's budget exactly.

Each source gets a word budget. As many whole copies of the source as fit are taken; what is left is a
subset-sum problem over exact token lengths: a seeded share of every length first, then a bounded-knapsack
dynamic program over the lengths' remaining counts. Which documents of a length are taken is decided by
a seeded hash, so reruns agree.

The dynamic program holds one bit set and one table of the steps that first reach each sum, for sums up to four times the longest document.

Defined cases: a null text has size 0; a document of size 0 is never taken. Documents with a null id are told apart by their texts. Null sources form one source, last in order.
Repeated rows are separate documents (equal rows are interchangeable). An empty table gives an
empty result. Other columns are ignored by ``mix_sources`` and kept by ``expand_mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.llm.common import WORD, Scratch, bounded_broadcast, unused

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
#: Mixture components; more than this is refused, since shares are set on the driver.
MAX_SOURCES = 1_000_000
#: Hash slices of a (source, length) group: of each group, one slice at most is ranked in a window.
SLICES = 4096


def fair_targets(
    sizes: dict[str | None, int],
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_copies: int = MAX_COPIES,
) -> dict[str | None, float]:
    """Targets in proportion to the weights, none above max_copies times its size: the excess of those
    above goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget = sum(sizes.values()) * share_percent / 100
    targets: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > max_copies * sizes[s]]
        if not over:
            targets |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            targets[s] = float(max_copies * sizes[s])
            budget -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (> 0) to take so that the words come as near below ``budget`` as the
    method finds: a like share of every length, the longest of what is left, then an exact bounded knapsack."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    # Exact integers: products of counts and budgets can pass 2**63.
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * take).sum())
    bound = 4 * int(lengths.max())
    for j in np.argsort(-lengths, kind="stable"):
        if rest <= bound:
            break
        k = min(int(counts[j] - take[j]), (rest - bound) // int(lengths[j]))
        take[j] += k
        rest -= k * int(lengths[j])
    # Bit s of ``reach``: some choice sums to s. ``first[s]``: the step that first reached it; steps before that reach the rest of it.
    mask = (1 << (rest + 1)) - 1
    reach, steps, first = 1, [], np.full(rest + 1, -1, np.int32)
    for j in np.argsort(-lengths, kind="stable"):
        left, k = min(int(counts[j] - take[j]), rest // int(lengths[j])), 1
        while left > 0 and not reach >> rest & 1:
            k = min(k, left)
            new = (reach << (k * int(lengths[j]))) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((int(j), k))
                reach |= new
            left, k = left - k, 2 * k
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        j, k = steps[first[at]]
        take[j] += k
        at -= k * int(lengths[j])
    return take


def _whole_copies(goal: int, size: int) -> int:
    return min(goal // size, MAX_COPIES) if size else MAX_COPIES


def _plan_source(seed_targets: dict[str | None, float]):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        target = seed_targets[None if pd.isna(source) else source]
        pdf = pdf[pdf["size"] > 0]
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total = int((lengths * counts).sum())
        goal = round(target)
        copies = _whole_copies(goal, total)
        extra = fit_budget(lengths, counts, goal - copies * total) if copies < MAX_COPIES else counts * 0
        return pd.DataFrame({"source": pdf["source"], "size": lengths, "extra": extra})

    return plan


def mix_sources(
    docs: DataFrame,
    seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies and taken (copies * size)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))).alias("dice"),
    ).withColumn("slice", F.pmod("dice", F.lit(SLICES)).cast("int"))
    sized = scratch.save(sized, "sized")
    spread = sized.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    by_length = spread.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = fair_targets({r["source"]: r["source_size"] for r in rows}, weights, share_percent)
    plan = scratch.save(
        by_length.groupBy("source").applyInPandas(
            _plan_source(targets), "source string, size long, extra long"
        ),
        "plan",
    )
    # Of a (source, length) group the slices before ``cut`` are taken whole, of slice ``cut`` the first ``some``.
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    needed = plan.where("extra > 0").withColumnRenamed("source", "p_source").withColumnRenamed("size", "p_size")
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    cuts = (
        spread.join(needed, same)
        .drop("p_source", "p_size")
        .withColumn("before", before)
        .where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("n") >= F.col("extra")))
        .select(
            F.col("source").alias("c_source"),
            F.col("size").alias("c_size"),
            F.col("slice").alias("cut"),
            (F.col("extra") - F.col("before")).alias("some"),
        )
    )
    cut_of = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    marked = sized.join(cuts, cut_of, "left").drop("c_source", "c_size")
    on_cut = F.col("slice") == F.col("cut")
    ranked = marked.where(on_cut).withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("dice", "doc_id"))
    )
    chosen = ranked.withColumn("extra", (F.col("rank") <= F.col("some")).cast("long")).drop("rank").unionByName(
        marked.where(~F.coalesce(on_cut, F.lit(False))).withColumn(
            "extra", F.coalesce((F.col("slice") < F.col("cut")).cast("long"), F.lit(0))
        )
    )
    sources = _source_table(docs, rows, targets)
    joined = chosen.join(sources, F.col("source").eqNullSafe(F.col("s_source")), "left")
    copies = F.when(F.col("size") > 0, F.col("base_copies") + F.col("extra")).otherwise(F.lit(0))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def _source_table(docs: DataFrame, rows: list, targets: dict[str | None, float]) -> DataFrame:
    """One row for each source; broadcast if there are few."""
    table = [
        (s, n, targets[s], _whole_copies(round(targets[s]), n)) for s, n in ((r["source"], r["source_size"]) for r in rows)
    ]
    df = docs.sparkSession.createDataFrame(table, "s_source string, source_size long, target double, base_copies long")
    return bounded_broadcast(df, 100_000)


def expand_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns.

    Rows that share an id are taken as often in all as the mix takes them together.
    """
    mix_id, copies, rows, rank, copy = unused(docs, "_mix_id", "_mix_copies", "_mix_rows", "_mix_rank", "_mix_copy")
    per_id = mixed.groupBy(F.col("doc_id").alias(mix_id)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    joined = docs.join(per_id, F.col(f"`{id_col}`").eqNullSafe(F.col(mix_id)))
    repeated = Window.partitionBy(mix_id).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    # Only ids that occur more than once need a rank; for the others it is 1.
    once = joined.where(F.col(rows) == 1).withColumn(rank, F.lit(1))
    more = joined.where(F.col(rows) > 1).withColumn(rank, F.row_number().over(repeated))
    share = F.expr(f"{copies} div {rows} + if({rank} <= {copies} % {rows}, 1, 0)").cast("int")
    return (
        once.unionByName(more)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), share)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
