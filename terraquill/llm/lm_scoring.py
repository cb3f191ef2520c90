"""Language-model scoring with Brown class bigrams.

Every training word has one of ``CLASSES`` classes, from its own contexts; the end of a text keeps a class of its own.

1. The ``HEAD`` most frequent words are clustered exactly: units move, one after another, to the class that most raises the
   class-bigram likelihood, until a round moves none or ``ROUNDS`` are done. All other words start in ``ENDINGS`` units by a
   hash of their last two bytes, which move along.
2. In a round over the whole vocabulary, every other word's neighbours are counted by class and side, and
   the word moves to the class under which its contexts are likeliest by the class bigrams found so far, its own pairs left
   out. All words of the round move at once, so only the class matrix goes to the tasks. (A second such round, with the classes of the first,
   lowered the held-out likelihood slightly and cost twice the shuffle.)

    log10 P(word | class before) = log10 P(class | class before) + log10 P(word | class)

Class transitions are interpolated with class frequencies (additive weight ``PRIOR``); emission is (c + 1) / (N_class + V_class + 1), which
leaves each class one share for words that were never seen.

Counts cover all training documents: words are counted in each task and summed by a shuffle; contexts
likewise. Counts and classes of the ``CACHED`` most frequent words travel with the tasks (a fixed bound); all
other words of a document meet theirs in a join.

Defined cases: a null text is empty and scores as one end. An empty table gives an empty result; without training documents
every count is 0. A word that no training document holds has no contexts and takes the class of its ending. Rows with a null doc_id
are held out. Repeated rows count and give rows each. Ties in frequency go by the word's bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.common import Scratch, utf8

HEAD, ENDINGS, CLASSES, ROUNDS = 1024, 256, 48, 6
CACHED = 100_000
PRIOR = 10.0
#: Entries after which a task passes on its partial counts.
FLUSH = 300_000
#: Tokens after which a task passes on its partial contexts.
FLUSH_TOKENS = 1_500_000
#: The end of a text; no word can be empty.
END = b""


class Units(dict):
    """Word to starting unit: frequent words by table, others by their ending."""

    def __missing__(self, word: bytes) -> int:
        return HEAD + 1 + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % ENDINGS


N_UNITS = HEAD + 1 + ENDINGS
_END_UNIT = HEAD


class Classes(dict):
    """Word to class: the most frequent words by table, others by the class of their ending."""

    def __init__(self, known: dict[bytes, int], units: Units, of: np.ndarray):
        super().__init__(known)
        self.units, self.of = units, of

    def __missing__(self, word: bytes) -> int:
        return int(self.of[self.units[word]])

    def __reduce__(self):
        return Classes, (dict(self), self.units, self.of)


@dataclass(frozen=True)
class Model:
    units: Classes
    transition: np.ndarray | None  # log10 P(class | class before)
    class_of: np.ndarray  # the class of what ``units`` gives: itself
    class_tokens: np.ndarray  # N_class + V_class + 1
    cached: dict[bytes, int]
    n: int
    v: int


def _tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    for b in batches:
        for text in utf8(b.column(0)):
            counts.update(_tokens(text))
            if len(counts) >= FLUSH:
                yield out()
                counts = Counter()
    yield out()


def _bigram_counts(units: Units):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_UNITS * N_UNITS, np.int64)
        for b in batches:
            texts = utf8(b.column(0))
            for at in range(0, len(texts), 256):
                u = [_END_UNIT]
                for text in texts[at : at + 256]:
                    u.extend(map(units.__getitem__, _tokens(text)))
                u = np.array(u, np.int64)
                pair, n = np.unique(u[:-1] * N_UNITS + u[1:], return_counts=True)
                total[pair] += n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return count


def exchange_classes(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit: greedy exchange on the class-bigram likelihood. ``pairs``: unit bigram counts."""
    n_units = len(pairs)
    freq = pairs.sum(1)
    order = np.argsort(-freq, kind="stable")
    of = np.empty(n_units, np.int64)
    movable = [u for u in order if u != _END_UNIT and freq[u]]
    of[order] = np.arange(n_units) % (classes - 1)
    of[_END_UNIT] = classes - 1
    entropy = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    joint = np.zeros((classes, classes))
    np.add.at(joint, (of[:, None], of[None, :]), pairs)
    for _ in range(rounds):
        moved = 0
        for u in movable:
            home = of[u]
            right = np.bincount(of, pairs[u], classes)
            left = np.bincount(of, pairs[:, u], classes)
            own = pairs[u, u]
            right[home] -= own  # pairs with the unit itself move along with it
            left[home] -= own
            bare = joint.copy()
            bare[home] -= right
            bare[:, home] -= left
            bare[home, home] -= own
            rows, columns = bare.sum(1), bare.sum(0)
            # The gain of the likelihood, for every class, from adding the unit there.
            gain = (entropy(bare + right[None, :]) - entropy(bare)).sum(1) + (entropy(bare + left[:, None]) - entropy(bare)).sum(0)
            d = np.arange(classes)
            diagonal = bare[d, d]
            gain += entropy(diagonal + right + left + own) + entropy(diagonal) - entropy(diagonal + right) - entropy(diagonal + left)
            gain -= entropy(rows + right.sum() + own) - entropy(rows) + entropy(columns + left.sum() + own) - entropy(columns)
            # The unit's mass in other classes' rows and columns doesn't depend on where it goes.
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if best != home and gain[best] > gain[home] + 1e-9:
                of[u], moved = best, moved + 1
            else:
                best = home
            bare[best] += right
            bare[:, best] += left
            bare[best, best] += own
            joint = bare
        if not moved:
            break
    return of


def _smoothed(joint: np.ndarray) -> np.ndarray:
    """P(class | class before), interpolated with class frequencies."""
    share = _share(joint)
    return (joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR)


def _share(joint: np.ndarray) -> np.ndarray:
    return (joint.sum(0) + 1) / (joint.sum() + CLASSES)


class _Local(dict):
    """Word to a number within the task; ``classes`` by number."""

    def __init__(self, known: Classes):
        self.known, self.words, self.classes = known, [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append(word)
        self.classes.append(self.known[word])
        return k


def _contexts(known: Classes):
    """Partial contexts: word, and how often a class stands after it (slot: the class) or before it (slot: CLASSES + the class)."""

    def rows(local: _Local, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words, of = pa.array(local.words, pa.binary()), np.array(local.classes, np.int64)
        first, second = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        keys = [first * 2 * CLASSES + of[second], second * 2 * CLASSES + CLASSES + of[first]]
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        word, starts = np.unique(key // (2 * CLASSES), return_index=True)
        offsets = pa.array(np.append(starts, len(key)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((key % (2 * CLASSES), pa.int16()), (n, pa.int32()))]
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), *lists], names=["word", "slots", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, pairs, n = _Local(known), [], 0
        for b in batches:
            texts = utf8(b.column(0))
            for at in range(0, len(texts), 256):
                u = [local[END]]
                for text in texts[at : at + 256]:
                    u.extend(map(local.__getitem__, _tokens(text)))
                u = np.array(u, np.int64)
                pairs.append((u[:-1], u[1:]))
                n += len(u)
                if n >= FLUSH_TOKENS or len(local) >= FLUSH:
                    yield from rows(local, pairs)
                    local, pairs, n = _Local(known), [], 0
        if pairs:
            yield from rows(local, pairs)

    return count


def _dense(b: pa.RecordBatch) -> np.ndarray:
    """Contexts by word and slot, of the list columns slots and counts."""
    slots, counts = (b.column(b.schema.get_field_index(k)) for k in ("slots", "counts"))
    row = np.repeat(np.arange(b.num_rows), np.diff(slots.offsets.to_numpy()))
    size = b.num_rows * 2 * CLASSES
    return np.bincount(row * 2 * CLASSES + slots.flatten().to_numpy(), counts.flatten().to_numpy(), size).reshape(-1, 2 * CLASSES)


def _cells(joint: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(joint)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(joint.ravel()[cell].astype(np.int64))], names=["cell", "n"])


def _collected(cells: DataFrame) -> np.ndarray:
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(CLASSES * CLASSES)
    joint[found["cell"].to_numpy()] = found["n"].to_numpy()
    return joint.reshape(CLASSES, CLASSES)


def best_classes(contexts: np.ndarray, n: np.ndarray, home: np.ndarray, joint: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The likeliest class of each word, by its contexts; its own pairs and tokens are left out of its present class."""
    after, before = contexts[:, :CLASSES], contexts[:, CLASSES:]
    log = np.log(_smoothed(joint))
    score = after @ log.T + before @ log - n[:, None] * np.log(size)
    share, total = _share(joint), joint.sum(1)
    bare = np.maximum(joint[home] - after, 0)
    own = (after * np.log((bare + PRIOR * share) / (bare.sum(1, keepdims=True) + PRIOR))).sum(1)
    bare = np.maximum(joint.T[home] - before, 0)
    own += (before * np.log((bare + PRIOR * share[home][:, None]) / (total + PRIOR))).sum(1)
    own -= n * np.log(np.maximum(size[home] - n - 1, 1))
    score[np.arange(len(home)), home] = own
    score[:, CLASSES - 1] = -np.inf
    return score.argmax(1)


def _choose(known: Classes, fixed: frozenset[bytes], joint: np.ndarray, size: np.ndarray):
    """Words with their number and class, of their contexts; every token but the end has one token after it."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(b.schema.get_field_index("word"))
            contexts, listed = _dense(b), words.to_pylist()
            n = contexts[:, :CLASSES].sum(1)
            home = np.fromiter(map(known.__getitem__, listed), np.int64, b.num_rows)
            best = best_classes(contexts, n, home, joint, size)
            stays = np.fromiter((w in fixed for w in listed), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(n.astype(np.int64)), pa.array(np.where(stays, home, best), pa.int32())], names=["word", "n", "class"]
            )

    return choose


def _starting_sizes(known: Classes):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(CLASSES, np.int64)
        for b in batches:
            of = np.fromiter(map(known.__getitem__, b.column(0).to_pylist()), np.int64, b.num_rows)
            size += np.bincount(of, b.column(1).to_numpy() + 1.0, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(size)], names=["class", "n"])

    return add


def _sizes(found: DataFrame) -> np.ndarray:
    """N_class + V_class + 1 of rows (class, n: tokens and words)."""
    size = np.ones(CLASSES)
    for r in found.groupBy("class").agg(F.sum("n").alias("n")).collect():
        size[r["class"]] += r["n"]
    return size


def _known(words: DataFrame, units: Units, of: np.ndarray) -> Classes:
    top = words.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(CACHED).select("word", "class")
    return Classes({bytes(r["word"]): r["class"] for r in top.toLocalIterator()} | {END: CLASSES - 1}, units, of)


def cluster(training: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model without its transitions, and the table of all words (word binary, n long, class int)."""
    texts = training.select(F.col(text_col).alias("text"))
    counts = scratch.save(
        texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts"
    )
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(CACHED)
    cached = {bytes(r["word"]): r["n"] for r in top.toLocalIterator()}
    cached = dict(sorted(cached.items(), key=lambda x: (-x[1], x[0])))
    units = Units({w: k for k, w in enumerate(list(cached)[:HEAD])} | {END: _END_UNIT})
    cached[END] = next((r["n"] for r in counts.where(F.length("word") == 0).collect()), 0)
    found = (
        texts.mapInArrow(_bigram_counts(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    )
    pairs = np.zeros(N_UNITS * N_UNITS)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(N_UNITS, N_UNITS)
    of = exchange_classes(pairs)
    joint = np.zeros((CLASSES, CLASSES))
    np.add.at(joint, (of[:, None], of[None, :]), pairs)
    known = Classes({w: int(of[units[w]]) for w in cached}, units, of)
    size = _sizes(counts.mapInArrow(_starting_sizes(known), "class int, n long"))
    grouped = (
        texts.mapInArrow(_contexts(known), "word binary, slots array<smallint>, counts array<int>")
        .where(F.length("word") > 0)
        .groupBy("word")
        .agg(F.collect_list(F.struct("slots", "counts")).alias("parts"))
        .select("word", F.flatten("parts.slots").alias("slots"), F.flatten("parts.counts").alias("counts"))
    )
    chosen = grouped.mapInArrow(_choose(known, frozenset(units), joint, size), "word binary, n long, class int")
    end = counts.where(F.length("word") == 0).select("word", "n", F.lit(CLASSES - 1).alias("class"))
    words = scratch.save(chosen.union(end), "words")
    scratch.drop("counts")
    size = _sizes(words.select("class", (F.col("n") + 1).alias("n")))
    return Model(_known(words, units, of), None, np.arange(CLASSES), size, cached, n, v), words


def _spell(model: Model):
    """Per document, the classes that the tasks know by themselves (255 for others) and the sum of its cached words'
    logarithms; and rows of its other words with their places."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = model.units, TaskContext.get().partitionId() << 33
        at_of = {w: k for k, w in enumerate(model.cached)}
        # By number of the word, the last entry for words that the tasks don't know.
        count_of = np.array([*model.cached.values(), -1], np.int64)
        class_of = np.array([*(known.get(w, 255) for w in model.cached), 255], np.uint8)
        log_of = np.log10(np.maximum(count_of, 0) + 1.0)
        for b in batches:
            rows, n_known, sums, classes, words, endings, places = [], [], [], [], [], [], []
            for row, text in enumerate(utf8(b.column(2))):
                t = _tokens(text)
                k = np.fromiter(map(at_of.get, t, repeat(-1)), np.int32, len(t))
                rows.append(row)
                n_known.append(int((count_of[k] > 0).sum()))
                sums.append(float(log_of[k].sum()))
                classes.append(class_of[k].tobytes())
                words.append(None)
                endings.append(None)
                places.append(None)
                at = defaultdict(list)
                for i in np.flatnonzero(k < 0).tolist():
                    at[t[i]].append(i)
                rows.extend([row] * len(at))
                for column in (n_known, sums, classes):
                    column.extend([None] * len(at))
                words.extend(at)
                endings.extend(map(known.__getitem__, at))
                places.extend(at.values())
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(rows, np.int64) + done),
                    *(b.column(k).take(index) for k in (0, 1)),
                    pa.array(n_known, pa.int64()),
                    pa.array(sums, pa.float64()),
                    pa.array(classes, pa.binary()),
                    pa.array(words, pa.binary()),
                    pa.array(endings, pa.int32()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=["row", "doc_id", "held_out", "n_known", "sums", "classes", "word", "ending", "places"],
            )
            done += b.num_rows

    return spell


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes of the joined words at their places."""
    for b in batches:
        texts, others = b.column(4).to_pylist(), b.column(5)
        c = np.frombuffer(b"".join(texts), np.uint8).copy()
        starts = np.cumsum([0, *map(len, texts)])
        listed = pc.fill_null(pc.list_value_length(others), 0).to_numpy()
        found = pc.list_flatten(others)
        per_word = pc.list_value_length(found.field("places")).to_numpy(zero_copy_only=False)
        first = np.repeat(np.repeat(starts[:-1], listed), per_word)
        c[first + pc.list_flatten(found.field("places")).to_numpy()] = np.repeat(found.field("class").to_numpy(), per_word)
        out = [c[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(out, pa.binary())], names=["doc_id", "held_out", "n_known", "sums", "classes"])


def spelled(slim: DataFrame, model: Model, words: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents as classes: doc_id, held_out, n_known, sums (of log10(count + 1)) and classes (a byte for each token)."""
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(
        slim.select("doc_id", "held_out", "text").mapInArrow(
            _spell(model),
            f"row long, doc_id {kind}, held_out boolean, n_known long, sums double, classes binary, word binary, ending int, places array<int>",
        ),
        "spelled",
    )
    count = F.coalesce("n", F.lit(0))
    others = (
        rows.where("word is not null").select("row", "word", "ending", "places")
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(count > 0, F.size("places")).otherwise(0)).alias("more_known"),
            F.sum(F.size("places") * F.log10(count + 1.0)).alias("more"),
            F.collect_list(F.struct(F.coalesce("class", "ending").alias("class"), "places")).alias("others"),
        )
    )
    joined = rows.where("word is null").drop("word", "ending", "places").join(others, "row", "left").select(
        "doc_id", "held_out",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0))).alias("sums"), "classes", "others",
    )
    filled = scratch.save(joined.mapInArrow(_fill, f"doc_id {kind}, held_out boolean, n_known long, sums double, classes binary"), "filled")
    scratch.drop("spelled")
    return filled


def _joint_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joint = np.zeros(CLASSES * CLASSES, np.int64)
    for b in batches:
        # Every text ends with the end's class, which so stands before the next text.
        c = np.frombuffer(bytes([CLASSES - 1]) + b"".join(b.column(0).to_pylist()), np.uint8).astype(np.int64)
        joint += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    yield _cells(joint)


def with_transitions(model: Model, filled: DataFrame) -> Model:
    training = filled.where(~F.col("held_out")).select("classes")
    joint = _collected(training.mapInArrow(_joint_of_texts, "cell long, n long"))
    return replace(model, transition=np.log10(_smoothed(joint)))


def train(training: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of all words (word binary, n long, class int)."""
    model, words = cluster(training, scratch, text_col)
    slim = training.select(F.lit(0).alias("doc_id"), F.lit(False).alias("held_out"), F.col(text_col).alias("text"))
    return with_transitions(model, spelled(slim, model, words, scratch)), words


def _score(model: Model):
    """Scores of documents that are spelled as classes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of = np.log10(model.n + 1.0 * (model.v + 1))
        log_size = np.log10(model.class_tokens)
        for b in batches:
            n_tokens, base, own = [], [], []
            for text, sums in zip(b.column(4).to_pylist(), b.column(3).to_pylist()):
                c = np.frombuffer(text, np.uint8)
                before = np.concatenate([np.array([CLASSES - 1], np.uint8), c[:-1]])
                n_tokens.append(len(c))
                base.append(sums - base_of * len(c))
                own.append(float(model.transition[before, c].sum() - log_size[c].sum() + sums))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(3)), pa.array(n_tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
                names=["doc_id", "held_out", "n_known", "n_tokens", "base_score", "score"],
            )

    return score


def class_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2
) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    scratch = Scratch(docs.sparkSession, "lm_scoring")
    ids = F.col(id_col).cast("string")
    held_out = F.coalesce(F.pmod(F.crc32(ids), F.lit(folds)) == held_fold, F.lit(True))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    model, words = cluster(slim.where(~F.col("held_out")), scratch)
    filled = spelled(slim, model, words, scratch)
    model = with_transitions(model, filled)
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = filled.mapInArrow(
        _score(model), f"doc_id {kind}, held_out boolean, n_known long, n_tokens long, base_score double, score double"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
