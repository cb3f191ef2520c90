"""Benchmark decontamination: which test items occur inside which documents.

Both sides are sets of five-word shingles. Items are partitioned by set size into classes of up to
4, 8, 16 ... shingles. A document, however long, is seen by a class as overlapping windows of twice the class's
size, so that the set sizes of both sides stay within a known factor and the containment threshold becomes a Jaccard
threshold that does not fall with the document's length. A window and an item are candidates if any of ``PERMUTATIONS`` minima agree;
candidates are verified by exact containment: shared shingles of the whole document / shingles of the item.

A minimum can only agree where the window holds a shingle of the item, so only windows with a shingle of some
item get signatures. An item spread over several places of a document counts at each of them: with
containment 0.75 the miss probability is about exp(-0.75 * PERMUTATIONS / 5) = 6e-9.

The items are the query set: they are taken in blocks whose index has about ``BLOCK_BYTES``, each of which goes to all
documents. The driver holds the index of one block at a time: with several blocks, what one finds (``contamination``) or leaves (``clean``) is written before the next one is
built, and the documents are read once for each block. Documents are neither shuffled nor joined.

Defined cases: null texts and texts without words neither match nor are matched. An item of fewer than five words is one
shingle, its whole sequence, looked for as such a run of words. Repeated documents or items each give their rows; an empty
table on either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraquill.llm.common import SHINGLE, SIMILARITY, Scratch, multipliers, shingle_hashes, slices, utf8

PERMUTATIONS = 128
SMALLEST = 4
BLOCK_BYTES = 64 << 20
#: Bytes of an item in the index besides its shingles: its minima, with permutation and item.
ITEM_BYTES = PERMUTATIONS * 14 + 128
_FACTORS = multipliers(PERMUTATIONS, 30_011)


@dataclass(frozen=True)
class SizeClass:
    """Items of k-word shingles with at most ``size`` of them: a sorted table of (minimum, permutation, item)."""

    k: int
    size: int
    minima: np.ndarray
    permutation: np.ndarray
    item: np.ndarray


@dataclass(frozen=True)
class Index:
    sets: list[np.ndarray]
    classes: list[SizeClass]
    known: dict[int, np.ndarray]  # by k, all shingles of items, sorted
    seen: dict[int, np.ndarray]  # by k, whether some item has a shingle with these top 16 bits


def build_index(texts: list[bytes | None]) -> Index:
    words = [(t or b"").lower().split() for t in texts]
    sets = [np.unique(shingle_hashes(w)) for w in words]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (w, s) in enumerate(zip(words, sets)):
        if len(s):
            size = max(SMALLEST, 1 << (len(s) - 1).bit_length())
            groups.setdefault((min(len(w), SHINGLE), size), []).append(i)
    classes, known, seen = [], {}, {}
    for (k, size), members in sorted(groups.items()):
        low = np.stack([(sets[i][:, None] * _FACTORS).min(0) for i in members])
        flat = low.ravel()
        order = np.argsort(flat, kind="stable")
        classes.append(
            SizeClass(k, size, flat[order], np.tile(np.arange(PERMUTATIONS, dtype=np.int16), len(members))[order], np.repeat(np.array(members, np.int32), PERMUTATIONS)[order])
        )
    for k in {c.k for c in classes}:
        known[k] = np.unique(np.concatenate([sets[i] for c in classes if c.k == k for i in groups[k, c.size]]))
        seen[k] = np.zeros(1 << 16, bool)
        seen[k][known[k] >> np.uint64(48)] = True
    return Index(sets, classes, known, seen)


def _hits(h: np.ndarray, index: Index, k: int) -> np.ndarray:
    """Positions of shingles that some item has."""
    maybe = np.flatnonzero(index.seen[k][h >> np.uint64(48)])
    known = index.known[k]
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    return maybe[known[at] == h[maybe]]


def _candidates(h: np.ndarray, hits: np.ndarray, c: SizeClass) -> set[int]:
    """Items of the class that agree in a minimum with one of the windows that hold a hit."""
    found: set[int] = set()
    # Windows of twice the size start at every multiple of it.
    starts = np.unique(np.concatenate([hits // c.size, np.maximum(hits // c.size - 1, 0)])) * c.size
    for s in starts:
        low = (h[s : s + 2 * c.size, None] * _FACTORS).min(0)
        first, last = np.searchsorted(c.minima, low, "left"), np.searchsorted(c.minima, low, "right")
        for p in np.flatnonzero(last > first):
            of = slice(first[p], last[p])
            found.update(c.item[of][c.permutation[of] == p].tolist())
    return found


def contained_items(text: bytes | None, index: Index, threshold: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(item, shared shingles, shingles of the item) for each item that the text contains."""
    words = (text or b"").lower().split()
    out = []
    for k in index.known:
        if len(words) < k:
            continue
        h = shingle_hashes(words, k)
        hits = _hits(h, index, k)
        if not len(hits):
            continue
        have = np.unique(h[hits])
        for i in sorted(set().union(*(_candidates(h, hits, c) for c in index.classes if c.k == k))):
            shared = int(np.isin(index.sets[i], have, assume_unique=True).sum())
            if shared >= threshold * len(index.sets[i]):
                out.append((i, shared, len(index.sets[i])))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks whose index has about ``BLOCK_BYTES``; a block goes through the driver."""
    slim = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    # A word is two bytes at least, and a shingle is held twice, as a hash of eight bytes.
    total = slim.agg(F.sum(9 * F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        part = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else slim
        rows = part.collect()
        if rows:
            yield [(r["item_id"], r["text"].encode()) for r in rows]


def _with_last(blocks: Iterator) -> Iterator[tuple[list, bool]]:
    """The blocks, each with whether it is the last one; one is read ahead."""
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        yield block, following is None
        block = following


def contamination(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item that a document contains."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = slim.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, n_shared long, n_item long, containment double"

    def search(block: list[tuple[object, bytes]]) -> DataFrame:
        index, ids, item_kind = build_index([t for _, t in block]), [i for i, _ in block], to_arrow_type(item_type)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows, found = [], []
                for row, text in enumerate(utf8(b.column(1))):
                    for i, shared, n in contained_items(text, index, threshold):
                        rows.append(row)
                        found.append((ids[i], shared, n, shared / n))
                columns = list(zip(*found)) or [()] * 4
                kinds = (item_kind, pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        return slim.mapInArrow(scan, schema)

    scratch, found = Scratch(docs.sparkSession, "contamination"), []
    for k, (block, last) in enumerate(_with_last(item_blocks(items, item_id_col, item_text_col))):
        hits = search(block)
        found.append(hits if last and not k else scratch.save(hits, f"block{k}"))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(
    docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents in which no item is found, with all their columns; nothing is joined or shuffled."""
    place = docs.columns.index(text_col)

    def without(index: Index):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                free = [not contained_items(x, index, threshold) for x in utf8(b.column(place))]
                yield b.filter(pa.array(free, pa.bool_()))

        return keep

    scratch = Scratch(docs.sparkSession, "clean")
    for k, (block, last) in enumerate(_with_last(item_blocks(items, item_id_col, item_text_col))):
        docs = docs.mapInArrow(without(build_index([t for _, t in block])), docs.schema)
        if not last:
            docs = scratch.save(docs, f"left{k}")
            if k:
                scratch.drop(f"left{k - 1}")
    return docs
