"""Quality classification with hierarchical empirical Bayes over sites.

A document classifier (logistic regression on bounded text features, fitted on a bounded seeded sample of labelled rows) gives each
document a probability of being bad. Sites are counted at two levels, host and path within the host: the
sums of these probabilities. A host's posterior is shrunk towards the mean of all hosts, and a path's towards its host's, each with the
weight that the spread of its level beyond noise gives (``shrinkage``). A document's own evidence is left out of its site's sums,
and enters by Bayes' rule: the log odds of its evidence, shifted from the global rate to its site's.

``site_col`` names the site: a URL, or host/path. What stands before the first ``/`` is the host, the next segment the path. A site without a path
has the host level only. ``documents`` has no URL; its ``source`` is the host there, and the path level is empty.

Labels are quality 0/1 (1: good) and, where the table has it, toxic 0/1 (1: toxic). Toxicity has a head of its own, which sites
don't shift; its words are learned from the sample: words whose share in toxic rows is far above that in others. A
document is kept if both heads stay below the threshold.

Defined cases: a null text counts as empty. Null sites form one host. Labels without a document, or null, are
not learned from. Without any labels all documents score 0 and are kept; a head whose labels are all alike scores near that label. Repeated rows each count and
give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm import shrinkage
from terraquill.llm.common import Scratch, lower_ascii, utf8
from terraquill.llm.quality_rules import repeated_words

MAX_TRAIN = 8000
MIN_TOXIC_ROWS, MIN_TOXIC_RATIO = 4, 20.0
STEPS, RATE, DECAY = 400, 0.5, 1e-4
THRESHOLD = 0.5

_SYMBOLS = b"#*$%&|<>!{}[]~^=+_"
_STRIP = b".,;:!?\"'()[]{}<>#*$%&|-_+=~^"


@dataclass(frozen=True)
class Classifier:
    """Two linear heads, bad quality and toxic, on standardised features."""

    weights: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    toxic: frozenset[bytes]

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([features(t, self.toxic) for t in texts]).reshape(len(texts), len(self.mean))
        return 1 / (1 + np.exp(-((x - self.mean) / self.spread @ self.weights + self.bias)))


def plain_words(text: bytes | None) -> list[bytes]:
    return [w.strip(_STRIP) for w in (text or b"").lower().split()]


def features(text: bytes | None, toxic: frozenset[bytes]) -> list[float]:
    """Shares and logarithms, each within a fixed range whatever the text's length."""
    text = text or b""
    words = text.split()
    n = max(len(words), 1)
    chars = max(len(text), 1)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    bad = [w for w in plain_words(text) if w in toxic] if toxic else []
    return [
        np.log1p(len(words)) / 5,
        min(chars / n, 40.0) / 10,
        upper / max(upper + lower, 1),
        digits / chars,
        min(symbols / n, 4.0),
        1 - len(set(words)) / n,
        repeated_words(words) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(text.count(b"|") / n, 1.0),
        min(len(set(bad)), 3) / 3,
        min(100 * len(bad) / n, 5.0),
    ]


def fit(x: np.ndarray, y: np.ndarray, toxic: frozenset[bytes]) -> Classifier:
    """Full-batch logistic regression in numpy; one column of y for each head."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / spread
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(STEPS):
        slope = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= RATE * (z.T @ slope / len(y) + DECAY * w)
        b -= RATE * slope.mean(0)
    return Classifier(w, b, mean, spread, toxic)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, toxic in zip(utf8(b.column(0)), b.column(2).to_pylist()):
            words = list(set(plain_words(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([toxic] * len(words), pa.int32())], names=["word", "toxic"]
            )


def _sample_features(toxic: frozenset[bytes]):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, toxic) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "quality", "toxic"]
            )

    return describe


def train(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"
) -> Classifier | None:
    """A classifier fitted on a bounded seeded sample of the labelled documents; None if there are none."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    marked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("l_id"), F.col("quality").cast("int").alias("quality"), toxic.cast("int").alias("toxic")
    )
    sample = marked.orderBy(F.xxhash64(F.lit(17), "l_id"), "l_id", "quality", "toxic").limit(MAX_TRAIN)
    texts = scratch.save(
        docs.select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), F.col("t_id") == F.col("l_id"))
        .select("text", "quality", "toxic"),
        "sample",
    )
    n, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return None
    inside, outside = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    ratio = (inside / max(n_toxic, 1)) / ((outside + 0.5) / max(n - n_toxic, 1))
    words = (
        texts.mapInArrow(_distinct_words, "word binary, toxic int")
        .groupBy("word")
        .agg(inside.alias("inside"), ratio.alias("ratio"))
        .where((F.length("word") > 0) & (F.col("inside") >= MIN_TOXIC_ROWS) & (F.col("ratio") >= MIN_TOXIC_RATIO))
    )
    listed = frozenset(bytes(r["word"]) for r in words.collect())
    rows = texts.mapInArrow(_sample_features(listed), "x array<double>, quality int, toxic int").collect()
    scratch.drop("sample")
    rows.sort(key=lambda r: (r["quality"], r["toxic"], r["x"]))
    y = np.array([(1 - r["quality"], r["toxic"]) for r in rows], float)
    return fit(np.array([r["x"] for r in rows]), np.clip(y, 0, 1), listed)


def site_parts(site: Column) -> tuple[Column, Column]:
    """Host and first path segment (null if there is none) of a URL or a host/path."""
    head = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)"
    host = lower_ascii(F.regexp_extract(site, head, 1))
    return host, F.nullif(F.regexp_extract(site, head + "/+([^/?#]+)", 2), F.lit(""))


def with_site_rates(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """``scored`` (host, path, bad: probability) with ``host_rate`` and ``site_rate``, posteriors that leave the row itself out; and the global rate."""
    sums = F.count("*").alias("n"), F.sum("bad").alias("f"), F.sum(F.col("bad") * F.col("bad")).alias("q")
    paths = scratch.save(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("q").alias("q")), "hosts")
    rate, host_weight = shrinkage.prior(hosts)
    # Within hosts: how far paths stand from their host's rate, of hosts with several paths.
    inside = paths.where("path is not null")
    _, path_weight = shrinkage.prior(_centred(inside, hosts))
    h = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("f").alias("h_f"))
    p = inside.select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), F.col("n").alias("p_n"), F.col("f").alias("p_f"))
    joined = shrinkage.join_groups(scored, h, {"host": "h_host"}, "h_n")
    placed = shrinkage.join_groups(joined.where("path is not null"), p, {"host": "p_host", "path": "p_path"}, "p_n")
    joined = placed.unionByName(joined.where("path is null"), allowMissingColumns=True)
    own = F.col("bad")
    host_rate = shrinkage.posterior(F.col("h_f") - own, F.col("h_n") - 1, rate, host_weight)
    path_rate = shrinkage.posterior(F.col("p_f") - own, F.col("p_n") - 1, F.col("host_rate"), path_weight)
    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("site_rate", F.coalesce(path_rate, F.col("host_rate")))
        .drop("h_n", "h_f", "p_n", "p_f"),
        rate,
    )


def _centred(paths: DataFrame, hosts: DataFrame) -> DataFrame:
    """Paths' sums (n, f, q) with their host's rate moved to one half, so that only the spread inside hosts is left."""
    h = hosts.select(F.col("host").alias("c_host"), F.col("n").alias("c_n"), (F.col("f") / F.col("n") - 0.5).alias("c"))
    met = shrinkage.join_groups(paths, h, {"host": "c_host"}, "c_n")
    n, f, q, c = (F.col(x) for x in ("n", "f", "q", "c"))
    return met.select("n", (f - n * c).alias("f"), (q - 2 * c * f + n * c * c).alias("q"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each document: doc_id, evidence (classifier), host_rate, site_rate, bad (posterior), quality, toxic and kept."""
    scratch = Scratch(docs.sparkSession, "quality_classifier")
    model = train(docs, labels, scratch, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(3))
            p = np.clip(model(texts), 1e-6, 1 - 1e-6) if model else np.full((len(texts), 2), 1e-6)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(p[:, 0]), pa.array(p[:, 1])],
                names=["doc_id", "host", "path", "bad", "toxic"],
            )

    host, path = site_parts(F.col(site_col).cast("string"))
    slim = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = scratch.save(
        slim.mapInArrow(score, f"doc_id {kind}, host string, path string, bad double, toxic double"), "scored"
    )
    rated, rate = with_site_rates(scored, scratch)
    logit = lambda p: F.log(p / (1 - p))
    site = F.least(F.greatest(F.col("site_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    bad = 1 / (1 + F.exp(-(logit(F.col("bad")) + logit(site) - float(np.log(rate / (1 - rate))))))
    return rated.select(
        "doc_id", F.col("bad").alias("evidence"), "host_rate", "site_rate", bad.alias("bad"), (1 - bad).alias("quality"), "toxic"
    ).withColumn("kept", (F.col("bad") < threshold) & (F.col("toxic") < threshold))
