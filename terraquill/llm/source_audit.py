"""Audit of how sources differ within a language, by smoothed shares of terms; all arithmetic exact.

1. A byte-level tokenizer: texts of a slice stay one UTF-8 buffer; a table of 256 entries says which bytes belong to terms (letters A-Z and a-z, all
   bytes from 0x80), a second one lower-cases A-Z. Edges of the marked runs, and of documents, are the terms' bounds.
2. Terms are grouped by their xxhash; every occurrence is compared byte by byte with its group's first one, and those that
   differ (a collision) are grouped by their bytes. Each slice gives (lang, source, term): occurrences and documents.
3. Spark adds these up. A language keeps the terms of at least ``MIN_DOCS`` of its documents; there are V of them.
   Every group (lang, source), and the language, gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)).
4. ``pair``: the sum over kept terms of abs(p - q) for every two sources of a language. Terms are dealt into blocks of about ``BLOCK``
   counts, or as many as there are pairs of sources, if that is more. In a block, sources by terms are a CSR matrix: values where a source has the term, its p at count 0 elsewhere.
   One source's values are spread over the terms, and ``reduceat`` gives the differences from every other row at once.
5. ``term``: per group the ``TOP`` terms with the largest p - q over the language's q; only these are ranked in a window.

Defined cases: null text, lang and source are ''. A document without terms still counts as one of its group; a group without kept terms has
count 0 for each of them; where no term is kept, pair values are 0 and there are no term rows. Repeated rows are
documents of their own. Equal values are ranked by the item's UTF-8 bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.llm.common import Scratch, bounded_broadcast

MIN_DOCS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of text that are tokenized at once (a longer text is taken by itself), and counts in a block of terms.
SLICE_BYTES = 8 << 20
BLOCK = 20_000
#: Rows of a table of groups or of kept terms that are broadcast; beyond it the tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each term of the documents data[offsets[k]:offsets[k + 1]]."""
    inside = _LETTER[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = offsets[:-1], offsets[1:]
    some = last > first
    opens[first[some]] = inside[first[some]]
    closes[last[some] - 1] = inside[last[some] - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the slices, one slice after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): slices are in one group exactly if their bytes are equal."""
    view = memoryview(data)
    h = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[first[group]]
    checked = np.flatnonzero(same)
    n = lengths[checked]
    equal = data[_spread(starts[checked], n)] == data[_spread(starts[first[group[checked]]], n)]
    if len(checked):
        same[checked] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    known: dict[bytes, int] = {}
    more = []
    for k in np.flatnonzero(~same):
        term = data[starts[k] : ends[k]].tobytes()
        if term not in known:
            known[term] = len(first) + len(more)
            more.append(k)
        group[k] = known[term]
    return group, np.concatenate([first, np.array(more, first.dtype)])


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, nulls as ''."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of (text, lang, source)."""
    for b in batches:
        data, offsets = _buffer(b.column(0))
        groups = pd.MultiIndex.from_arrays([b.column(k).to_pandas() for k in (1, 2)])
        code, names = pd.factorize(groups)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            low = _LOWER[data[offsets[at] : offsets[to]]]
            starts, ends, doc = term_bounds(low, offsets[at : to + 1] - offsets[at])
            if len(starts):
                term, of = group_slices(low, starts, ends)
                n_terms = len(of)
                in_doc, n = np.unique(doc * n_terms + term, return_counts=True)
                key = code[at + in_doc // n_terms] * n_terms + in_doc % n_terms
                keys, inverse = np.unique(key, return_inverse=True)
                lengths = (ends - starts)[of[keys % n_terms]]
                text = low[_spread(starts[of[keys % n_terms]], lengths)]
                ends_ = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends_), pa.py_buffer(text)])
                named = [names[k] for k in range(len(names))]
                lang, source = (pa.array([x[k] for x in named], pa.string()).take(pa.array(keys // n_terms)) for k in (0, 1))
                counts = np.bincount(inverse, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [lang, source, terms.cast(pa.binary()), pa.array(counts), pa.array(np.bincount(inverse))],
                    names=["lang", "source", "term", "n", "docs"],
                )
            at = to


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", top, (total + ADDED * kept).cast("decimal(19,0)"))).cast("long")


def block_differences(rows: np.ndarray, cols: np.ndarray, p: np.ndarray, base: np.ndarray, n_cols: int) -> np.ndarray:
    """The matrix of sums over ``n_cols`` terms of abs(p - q) between sources, of the values p at (source, term) and each source's
    value ``base`` at all other terms."""
    n = len(base)
    # One more column with every row's base: no row is empty then, and its difference is nil.
    rows, cols, p = np.concatenate([rows, np.arange(n)]), np.concatenate([cols, np.full(n, n_cols)]), np.concatenate([p, base])
    order = np.lexsort((cols, rows))
    rows, cols, p = rows[order], cols[order], p[order]
    ptr = np.searchsorted(rows, np.arange(n + 1))
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        q = np.full(n_cols + 1, base[i], np.int64)
        own = p[ptr[i] : ptr[i + 1] - 1]
        q[cols[ptr[i] : ptr[i + 1] - 1]] = own
        rest = slice(ptr[i + 1], None)
        against = q[cols[rest]]
        moved = np.add.reduceat(np.abs(p[rest] - against) - np.abs(base[rows[rest]] - against), ptr[i + 1 : -1] - ptr[i + 1])
        # All terms at the other source's base: a sum over this source's sorted values.
        own = np.sort(own)
        sums, below = np.concatenate([[0], np.cumsum(own)]), np.searchsorted(own, base[i + 1 :])
        at_own = base[i + 1 :] * (2 * below - len(own)) + sums[-1] - 2 * sums[below]
        out[i, i + 1 :] = moved + at_own + (n_cols - len(own)) * np.abs(base[i + 1 :] - base[i])
    return out


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    head = pdf[pdf["term"].isna()].sort_values("source")
    body = pdf[pdf["term"].notna()]
    names = head["source"].to_numpy()
    cols, terms = pd.factorize(body["term"])
    rows = np.searchsorted(names, body["source"].to_numpy())
    d = block_differences(rows, cols, body["p"].to_numpy(np.int64), head["p"].to_numpy(np.int64), len(terms))
    i, j = np.triu_indices(len(names), 1)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": names[i], "b": names[j], "value": d[i, j]})


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for all pairs of sources of a language, and the top terms of each group."""
    scratch = Scratch(docs.sparkSession, "source_audit")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    parts = slim.mapInArrow(_term_counts, "lang string, source string, term binary, n long, docs long")
    counts = scratch.save(
        parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts"
    )
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs)
    kept = scratch.save(kept.select("lang", "term", "of_lang"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    known = bounded_broadcast(kept.withColumnsRenamed({"lang": "k_lang", "term": "k_term"}), BROADCAST_ROWS)
    same = (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))
    held = scratch.save(counts.join(known, same).select("lang", "source", "term", "n", "of_lang"), "held")
    scratch.drop("counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = slim.groupBy("lang", "source").agg(F.count("*").alias("n_docs")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.save(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "v", "lang_total"))), "groups")
    # Blocks of a language: as many as its counts ask for.
    blocks = groups.groupBy("lang").agg(F.ceil(F.sum("n_terms") / F.greatest(F.lit(block), F.count("*") * F.count("*"))).cast("int").alias("blocks")).where("blocks > 0")
    slots = groups.join(bounded_broadcast(blocks, BROADCAST_ROWS), "lang")
    heads = slots.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"),
        share(F.lit(0), F.col("total"), F.col("v")).alias("p"),
    )
    sized = bounded_broadcast(slots.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "total", "v", "lang_total", "blocks"), BROADCAST_ROWS)
    shares = held.join(sized, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term",
        share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    sums = shares.drop("q").unionByName(heads).groupBy("lang", "block").applyInPandas(_pair_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")))), "value")
    # Languages without a kept term: every two sources differ by nothing.
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(both.unionByName(none)).withColumn("part", F.lit("pair"))
    terms = ranked(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    terms = terms.where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
