"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model is fitted by stochastic gradient descent in numpy on a bounded seeded sample of labelled rows (``MAX_TRAIN``
rows; all subwords of each whole text). Beside the languages it has one class for text of none of them, learned from texts made of the
sample: letters shuffled, letters replaced by others throughout, and random strings. Short runs of words of each
sampled text take part, so that short texts are judged too.

A part of the sample calibrates the model and is not fitted on: a temperature by log loss with smoothed targets, then the score below
which a prediction is rejected, between the scores of wrong or made-up texts and those of rightly named ones, at no more than
``MAX_LOST`` of the latter. Prediction averages the subwords of the whole text; the score is the probability of
the best language, so that it falls with the evidence of none.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Rows without a language or a doc_id are
never learned from. Without labelled rows every text is ``und`` with score 0 and nothing is rejected but
texts without letters. Ties go to the language first in code point order. Repeated rows each give a row. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.common import slices, utf8

MAX_TRAIN = 1500
CALIBRATION_SHARE = 0.25
BUCKETS, WIDTH = 1 << 15, 16
ORDERS = (2, 3, 4)
STEPS, BATCH, RATE = 700, 32, 0.5
#: Share of rightly named calibration texts that rejection may cost.
MAX_LOST = 0.001
#: Letters of made-up texts: code points of the scripts in common use.
_SCRIPTS = ((0x61, 0x7B), (0xE0, 0x180), (0x3B1, 0x3CA), (0x430, 0x450), (0x5D0, 0x5EB), (0x627, 0x64B), (0x905, 0x93A), (0x4E00, 0x9FA6))

_LETTER = re.compile(r"[^\W\d_]")
_PRIMES = np.array([1, 131, 17_161, 2_248_091], np.uint32)


@dataclass(frozen=True)
class Model:
    """Per bucket, each class's share of the logits (the last class is none of the languages); bias; temperature; least accepted score."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0


def subwords(text: bytes) -> np.ndarray:
    """Hashed buckets of all byte 2-, 3- and 4-grams of the lower-cased text, with a space at both ends."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    grams = []
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h += b[j : len(b) - n + 1 + j] * _PRIMES[j]
            h *= np.uint32(2_654_435_761)
            grams.append(h >> np.uint32(32 - 15))
    return np.concatenate(grams)


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class Bags:
    """Rows of subword buckets with their counts, end to end; ``starts`` has one more entry than there are rows."""

    bucket: np.ndarray
    weight: np.ndarray  # share of the row's subwords
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Bags:
        weight = [(n / n.sum()).astype(np.float32) for _, n in rows]
        return cls(np.concatenate([b for b, _ in rows]), np.concatenate(weight), np.cumsum([0] + [len(w) for w in weight]))

    def take(self, rows: np.ndarray) -> Bags:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Bags(self.bucket[at], self.weight[at], starts)

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.bucket] * self.weight[:, None], self.starts[:-1])

    def means(self, table: np.ndarray, rows: np.ndarray, at_once: int = BATCH) -> np.ndarray:
        """``mean`` of some rows, few at a time, so that the driver never holds the embeddings of all their subwords."""
        return np.concatenate([self.take(rows[k : k + at_once]).mean(table) for k in range(0, len(rows), at_once)])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str | None], groups: list[int], seed: int = 5) -> Model:
    """``rows``: subword buckets of a text and their counts; ``labels``: None for text of no language; rows of a group (of one document) are
    fitted on or calibrated with together."""
    languages = tuple(sorted({x for x in labels if x is not None}))
    y = np.array([len(languages) if x is None else languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    held = (rng.random(max(groups) + 1) < CALIBRATION_SHARE)[np.array(groups)]
    if not (~held).any() or not held.any():
        held[:] = False
    bags = Bags.of(rows)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (WIDTH, len(languages) + 1)).astype(np.float32), np.zeros(len(languages) + 1, np.float32)
    fitted = np.flatnonzero(~held)
    order = np.empty(0, np.int64)
    for step in range(STEPS):
        if len(order) < min(BATCH, len(fitted)):
            order = rng.permutation(fitted)
        r, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - step / STEPS)
        batch = bags.take(r)
        mean = batch.mean(emb)
        slope = softmax(mean @ top + bias)
        slope[np.arange(len(r)), y[r]] -= 1
        back = slope @ top.T * 8  # embeddings are averages, so their slopes are small
        slope /= len(r)
        top -= rate * (mean.T @ slope)
        bias -= rate * slope.sum(0)
        used, inverse = np.unique(batch.bucket, return_inverse=True)
        spread = np.repeat(back, np.diff(batch.starts), axis=0) * batch.weight[:, None]
        for k in range(WIDTH):
            emb[used, k] -= rate * np.bincount(inverse, spread[:, k], len(used)).astype(np.float32)
    if not held.any():
        return Model(languages, emb @ top, bias)
    temperature, least = calibrate(bags.means(emb, np.flatnonzero(held)) @ top + bias, y[held])
    return Model(languages, emb @ top, bias, temperature, least)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least smoothed log loss, and the least accepted score. The last class is text of no language."""
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + 2) / (classes - 1))
    target[np.arange(n), y] = 1 - 1 / (n + 2)
    grid = np.geomspace(1e-3, 1e3, 241)
    t = float(grid[int(np.argmin([-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum() for t in grid]))])
    p = softmax(logits / t)[:, :-1]
    score, right = p.max(1), p.argmax(1) == y
    if not right.any() or right.all():
        return t, 0.0
    good, wrong = np.sort(score[right]), np.sort(score[~right])
    # From the bar of least loss on, a lost right text weighing as ten wrong ones accepted; in the middle of its gap.
    bars = np.unique(score)
    cost = 10 * np.searchsorted(good, bars) / len(good) + 1 - np.searchsorted(wrong, bars) / len(wrong)
    k = int(np.argmin(cost))
    bar = (bars[k] + bars[k - 1]) / 2 if k else 0.0
    return t, float(min(bar, np.quantile(good, MAX_LOST)))


def made_up(text: str, rng: np.random.Generator) -> str:
    """Text of no language, from the words of one: shuffled, written in other letters, or random strings."""
    kind = rng.integers(4)
    words = np.array(text.split() or [text])
    first = int(rng.integers(len(words)))
    text = " ".join(words[first : first + 3 + int(rng.geometric(0.01))])
    if kind == 0:
        letters = [c for c in text if c != " "]
        rng.shuffle(letters)
        left = iter(letters)
        return "".join(c if c == " " else next(left) for c in text)
    if kind == 1:  # the same words in other letters of a script
        low, high = _SCRIPTS[rng.integers(len(_SCRIPTS))]
        letters = sorted({c for c in text.lower() if c.isalpha()})
        return text.lower().translate({ord(c): chr(x) for c, x in zip(letters, rng.integers(low, high, len(letters)))})
    if kind == 2:  # letters of a script at random
        low, high = _SCRIPTS[rng.integers(len(_SCRIPTS))]
        return "".join(c if c == " " else chr(x) for c, x in zip(text, rng.integers(low, high, len(text))))
    signs = np.array(list("0123456789abcdef" if rng.integers(2) else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/=_-(){};<>"))
    return "".join(c if c == " " and rng.integers(2) else x for c, x in zip(text, rng.choice(signs, len(text))))


def _sample_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text: the whole, a short run of its words, and a made-up text (lang null)."""
    for b in batches:
        langs, keys, buckets, counts = [], [], [], []
        for lang, raw in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            key = xxhash.xxh3_64_intdigest(raw) >> 1
            rng = np.random.default_rng(key)
            words = raw.split()
            first, n = int(rng.integers(len(words))), 2 + int(rng.integers(24))
            for of, text in ((lang, raw), (lang, b" ".join(words[first : first + n])), (None, made_up(raw.decode("utf-8", "replace"), rng).encode())):
                bucket, count = np.unique(subwords(text), return_counts=True)
                langs.append(of)
                keys.append(key)
                buckets.append(bucket.astype(np.uint16))
                counts.append(count.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(keys, pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (buckets, counts))],
            names=["lang", "key", "buckets", "counts"],
        )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5
) -> Model | None:
    """A model of the labelled documents outside fold 0; None if there are none."""
    ids = F.col(id_col).cast("string")
    rows = (
        docs.where((F.pmod(F.crc32(ids), F.lit(folds)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(3), ids).alias("dice"), ids.alias("id"))
    )
    # The sample is found without its texts, which follow by their dice; repeated ids are told apart by what they hold.
    last = rows.select("dice").orderBy("dice").limit(MAX_TRAIN).agg(F.max("dice")).first()[0]
    if last is None:
        return None
    sample = rows.where(F.col("dice") <= last).orderBy("dice", "id", F.xxhash64("text"), "lang").limit(MAX_TRAIN).select("lang", "text")
    found = sample.repartition(8).mapInArrow(_sample_bags, "lang string, key long, buckets binary, counts binary").collect()
    found = sorted((r["key"], r["lang"] or "", bytes(r["buckets"]), bytes(r["counts"]), r["lang"]) for r in found)
    group = {key: g for g, key in enumerate(sorted({r[0] for r in found}))}
    bags = [(np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.int32)) for r in found]
    return fit(bags, [r[4] for r in found], [group[r[0]] for r in found])


def predict(text: bytes | None, model: Model | None) -> tuple[str, float, bool]:
    if text is None or not has_letter(text):
        return "und", 0.0, True
    if model is None:
        return "und", 0.0, False
    g = subwords(text)
    logits = model.table[g].sum(0, dtype=np.float64) / len(g) + model.bias
    p = softmax(logits / model.temperature)[:-1]
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.least)


def identify(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5
) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score and rejected."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [predict(x, model) for x in utf8(b.column(2))]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"]
            )

    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(True))
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that aren't rejected, with all their columns; nothing is joined or shuffled."""
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([not predict(x, model)[2] for x in utf8(b.column(place))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
