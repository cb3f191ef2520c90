"""Quality rules with host verdicts.

Every text is held against fixed rules. Each soft rule has a margin: the text's value as a share of the rule's threshold, so that 1 is on the threshold; the
largest one counts. Soft failures are counted by host, and each host's rate is shrunk with an empirical beta prior (``shrinkage``: averaged over the prior's weight). A
document's log odds to fail are ``firmness`` for each threshold that it is beyond, plus the log odds of its host's posterior (its own outcome left out) over those
of the prior's mean; it is kept if they are not above 0. So hosts move documents near a rule, the more the surer they are known, and one far from all rules stays whatever its host is. A document
that fails a base rule goes whatever its host is.

Defined cases: a null text counts as empty (0 words, base rule failed). A null host is a host of its own; a host of one
document has the prior's mean, for nothing is known of it but that document. Repeated rows each count and each give a row. An empty table gives an empty result. Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm import shrinkage
from terraquill.llm.common import Scratch, utf8

_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the base rule and of the soft rules, and the log odds that a whole threshold is worth."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.1
    min_mean_word: float = 3.0
    max_mean_word: float = 12.0
    max_dup_line_share: float = 0.3
    firmness: float = 10.0


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text has at least twice."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    key = w[: n - width + 1]
    for j in range(1, width):  # pairs are renumbered, so that keys never overflow
        key = np.unique(key, return_inverse=True)[1] * len(ids) + w[j : n - width + 1 + j]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for j in range(width):
        inside[j : n - width + 1 + j] |= twice
    return int(inside.sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = np.array([text_counts(x) for x in utf8(b.column(2))], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(counts[:, j]) for j in range(len(_COUNTS)))],
            names=["doc_id", "host", *_COUNTS],
        )


def margin(rules: Rules) -> Column:
    """The largest share of a soft rule's threshold that a text has; 2 for a text without words."""
    n = F.col("n_words")
    middle, reach = (rules.min_mean_word + rules.max_mean_word) / 2, (rules.max_mean_word - rules.min_mean_word) / 2
    shares = (
        F.col("n_symbols") / (rules.max_symbols_per_word * F.nullif(n, F.lit(0))),
        F.abs(F.col("word_chars") / F.nullif(n, F.lit(0)) - middle) / reach,
        F.coalesce(F.col("n_dup_lines") / (rules.max_dup_line_share * F.nullif(F.col("n_lines"), F.lit(0))), F.lit(0.0)),
    )
    return F.when(n > 0, F.greatest(*shares)).otherwise(2.0)


def with_host_rates(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``counted`` with ``host_rate`` (posterior, the document itself left out) and ``host_shift``, its log odds over those of the prior's mean."""
    outcome = F.col("soft_failed").cast("double")
    hosts = scratch.save(counted.groupBy("host").agg(F.count("*").alias("n"), F.sum(outcome).alias("f"), F.sum(outcome).alias("q")), "hosts")
    mean, weight = shrinkage.prior(hosts)
    named = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("f").alias("h_f"))
    rate = shrinkage.posterior(F.col("h_f") - outcome, F.col("h_n") - 1, mean, weight)
    joined = shrinkage.join_groups(counted, named, {"host": "h_host"}, "h_n")
    inside = F.least(F.greatest(F.col("host_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(inside / (1 - inside)) - float(np.log(mean / (1 - mean)))
    return joined.withColumn("host_rate", rate).withColumn("host_shift", shift).drop("h_n", "h_f")


def host_quality_rules(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """One row for each document: counts, ``base_failed``, ``margin``, ``soft_failed`` (or a base rule), ``host_rate``, ``host_shift``, ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality_rules")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, host {slim.schema['host'].dataType.simpleString()}, "
    n = F.col("n_words")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    counted = scratch.save(
        slim.mapInArrow(_count_batches, schema + ", ".join(f"{c} long" for c in _COUNTS))
        .withColumn("base_failed", base)
        .withColumn("margin", margin(rules))
        .withColumn("soft_failed", base | (F.col("margin") > 1)),
        "counted",
    )
    judged = with_host_rates(counted, scratch)
    odds = rules.firmness * (F.col("margin") - 1) + F.col("host_shift")
    return judged.withColumn("kept", ~F.col("base_failed") & (odds <= 0))
