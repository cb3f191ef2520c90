"""Empirical Bayes for groups of very unlike sizes: how far a group's rate is shrunk towards the mean of all.

Groups are rows of (n, f, q): documents, sum of the documents' outcomes (0 to 1 each) and sum of their squares. A group's rate is shrunk by the factor
B = weight / (n0 + weight), where n0 is the groups' typical size. A point estimate of the weight runs off to infinity where the rates of few groups differ
by little more than noise; so B is averaged instead: over ``GRID`` values between 0 and 1, each as likely beforehand (the uniform shrinkage prior), by
the beta-binomial likelihood of all groups. The weight that the mean of B stands for is

    weight = n0 * E[B] / (1 - E[B])

documents, never infinite. Outcomes between 0 and 1 vary less within groups than outcomes of 0 and 1 of the same mean: by the ratio of the variances, their documents
count for more in the likelihood (quasi-likelihood). Where no group has two documents, or there is one group only, nothing is known of the spread and the
prior outweighs all (``NO_SPREAD``). The prior's mean weighs each group by n / (n + weight), so that one large group can't set it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_SPREAD = 1e15
GRID = 64
BROADCAST_SITES = 100_000
#: Groups with more than this share of all rows never meet in a shuffle.
HOT_SHARE = 0.002


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift that makes it exact to ten digits."""
    low = np.prod([z + k for k in range(8)], axis=0)
    z = z + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def log_likelihood(n: np.ndarray, f: np.ndarray, mean: float, weight: np.ndarray) -> np.ndarray:
    """For each weight, the logarithm of the beta-binomial likelihood of groups of n outcomes with sum f."""
    a, b = mean * weight, (1 - mean) * weight
    n, f = n[:, None], f[:, None]
    inside = log_gamma(f + a) - log_gamma(a) + log_gamma(n - f + b) - log_gamma(b) - log_gamma(n + weight) + log_gamma(weight)
    return inside.sum(0)


def _likelihoods(scale: float, mean: float, weight: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f = (batch.column(k).to_numpy(zero_copy_only=False) * scale for k in (0, 1))
            total = sum((log_likelihood(n[k : k + 4096], f[k : k + 4096], mean, weight) for k in range(0, len(n), 4096)), np.zeros(len(weight)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weight)), pa.int32()), pa.array(total)], names=["k", "value"])

    return sums


def prior(groups: DataFrame) -> tuple[float, float]:
    """(mean, weight) of the prior of groups n, f, q; a mean of 0.5 without any."""
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    k, total, failed, squares, between, inner = groups.agg(
        F.count("*"), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n), F.sum(F.col("q").cast("double"))
    ).first()
    if not total:
        return 0.5, NO_SPREAD
    bounded = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    weight, mean = NO_SPREAD, bounded(failed / total)
    if k > 1 and total > k:
        within = max(inner - between, 0.0) / (total - k)
        typical = (total - squares / total) / (k - 1)
        scale = min(max(mean * (1 - mean) / within if within > 0 else 1.0, 1.0), 1e4)
        factor = (np.arange(GRID) + 0.5) / GRID
        # In the likelihood's documents, of which ``scale`` make one of the table's.
        weights = typical * scale * factor / (1 - factor)
        rows = groups.select(n, f).mapInArrow(_likelihoods(scale, mean, weights), "k int, value double").groupBy("k").agg(F.sum("value")).collect()
        value = np.array([v for _, v in sorted(map(tuple, rows))])
        chance = np.exp(value - value.max())
        shrunk = float((chance * factor).sum() / chance.sum())
        weight = typical * shrunk / (1 - shrunk)
    share, size = groups.agg(F.sum(f / (n + weight)), F.sum(n / (n + weight))).first()
    return bounded(share / size), weight


def posterior(f: Column, n: Column, mean: float | Column, weight: float) -> Column:
    """The mean of a group's posterior."""
    return (f + F.lit(weight) * mean) / (n + F.lit(weight))


def join_groups(rows: DataFrame, groups: DataFrame, keys: dict[str, str], n_col: str) -> DataFrame:
    """Rows with their group's columns. ``keys``: the rows' key columns and the groups' (dropped); nulls are equal.

    Few groups are broadcast. Of more, only those that hold more than ``HOT_SHARE`` of all rows are, at most 1 / ``HOT_SHARE`` of
    them; the rest meet in a shuffle.
    """
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
    if groups.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        return rows.join(F.broadcast(groups), on).drop(*keys.values())
    total = groups.agg(F.sum(n_col)).first()[0]
    hot = F.col(n_col) > HOT_SHARE * total
    named = F.broadcast(groups.where(hot).select(*keys.values()))
    many = rows.join(F.broadcast(groups.where(hot)), on)
    return many.unionByName(rows.join(named, on, "left_anti").join(groups.where(~hot), on)).drop(*keys.values())
