"""Alignment of two tokenizers over a corpus: which tokens of A and B cover the same bytes, and how often they do.

A is a byte-level BPE (a ``.json`` vocabulary whose ids follow its merges), B a sentencepiece BPE with byte fallback. Both see a space and the text.
A space after a character that is not white space begins a token of both (A's pattern never crosses it; no piece of B goes on after a
character into a space, which is checked when B is read). So texts fall into chunks at such spaces, and a chunk's tokens don't
depend on its text: each distinct chunk of a slice is encoded and aligned once.

1. Alignment of all new chunks at once in numpy: cumulative sums of token lengths are the tokens' ends; ends that A and B share
   (``intersect1d``) are cuts, and ``searchsorted`` labels the tokens with their group. A token of A meets the tokens of B from the one that holds its
   first byte to the one that holds its last; ``repeat`` expands these ranges into links.
2. Each document keeps its distinct links and how often it has them, in a written table. Spark adds them up in two stages: by (link, salt), so that a link
   that most documents have is dealt over ``SALTS`` tasks, then by link. The highest count of each B id is one row for each id of B's vocabulary.
3. The documents' links meet the counts in a join (the counts are broadcast if there are at most ``SENT_PAIRS``) and are added up by document; all of
   a document's links lie in one partition, so these sums are shuffled as one row for each document.

Defined cases: null and empty texts, and texts whose tokens of A or B don't give back the space and the text, have no tokens: zeros and an empty digest.
They add no links. Repeated rows count each and give a row each. Very long texts form a slice of their own. An empty table gives an empty result.
Other columns are ignored. The tokenizers' folder is a parameter and must hold the files on every machine.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.common import Scratch, bounded_broadcast, utf8

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are taken at once, and chunks (and their bytes) that a worker remembers before it forgets the rare ones.
SLICE_BYTES = 2 << 20
CACHED, CACHED_BYTES = 200_000, 8 << 20
SALTS = 16
SENT_PAIRS = 4_000_000

#: Fixed value: the splitting pattern of the byte-level BPE.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][x + y] for x, y in merges]
        # Special tokens are no outcome of merges; their strings are plain text.
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i <= made[-1]}
        if made != sorted(made):
            raise ValueError("the ids of tokenizer A don't follow its merges")
        self.a = tiktoken.Encoding("A", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of tokenizer B goes on into a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of A and B of each chunk with a space before it."""
        a = [self.a.encode_ordinary(" " + c) for c in chunks]
        b = [x if c else [self.b_space] for x, c in zip(self.b.encode(chunks, num_threads=1), chunks)]
        return a, b


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(f"{folder}/{A_FILE}", f"{folder}/{B_FILE}")


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, group of each A token, group of each B token, A and B token of each link) of two tokenizations of the same bytes."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    left = np.repeat(np.arange(len(ends_a)), n)
    right = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), left, right


class Chunks:
    """Alignments of the chunks met so far: sizes, digest text, and links as (A id << 32 | B id)."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.bytes = 0
        # n_a, n_b, n_groups, n_links; a chunk that isn't given back by its tokens has n_a = -1.
        self.sizes = np.zeros((0, 4), np.int64)
        self.keys = np.zeros(0, np.int64)
        self.ptr = np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int64)

    def ids(self, flat: list[str]) -> np.ndarray:
        """The chunks' numbers, after the new ones are aligned."""
        if len(self.index) > CACHED or self.bytes > CACHED_BYTES:
            self._forget()
        new = [c for c in dict.fromkeys(flat) if c not in self.index]
        if new:
            self._add(new)
        out = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        self.hits += np.bincount(out, minlength=len(self.hits))
        return out

    def _forget(self) -> None:
        """Only chunks met more than once stay, at most half of ``CACHED``, of these no long ones; all begin to be counted anew."""
        most = np.argsort(-self.hits, kind="stable")[: CACHED // 2]
        stay = np.zeros(len(self.hits), bool)
        stay[most] = self.hits[most] > 1
        names = list(self.index)
        stay &= np.fromiter((len(c) <= 20 for c in names), bool, len(names))
        kept = np.flatnonzero(stay)
        self.keys, n = self.links(kept)
        self.ptr = np.concatenate([[0], np.cumsum(n)])
        self.sizes, self.hits = self.sizes[kept], np.zeros(len(kept), np.int64)
        names = [names[k] for k in kept.tolist()]
        self.texts = [self.texts[k] for k in kept.tolist()]
        self.index = dict(zip(names, range(len(names))))
        self.bytes = sum(map(len, names))

    def _add(self, new: list[str]) -> None:
        a, b = self.tok.encode(new)
        raw = [b" " + c.encode() for c in new]
        ab, bb = self.tok.a_bytes, self.tok.b_bytes
        flat = lambda ids, n: np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = flat(a, n_a), flat(b, n_b)
        good = np.ones(len(new), bool)
        # Mostly all chunks are given back; only if the slice isn't, each is looked at.
        if not b"".join(map(ab.__getitem__, flat_a.tolist())) == b"".join(raw) == b"".join(map(bb.__getitem__, flat_b.tolist())):
            good = np.array([b"".join(map(ab.__getitem__, x)) == r == b"".join(map(bb.__getitem__, y)) for x, y, r in zip(a, b, raw)])
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        where = np.flatnonzero(good)
        sizes = np.full((len(new), 4), [-1, 0, 0, 0], np.int64)
        texts = [""] * len(new)
        keys = np.zeros(0, np.int64)
        if len(where):
            n_a = n_a[where]
            cuts, group_a, group_b, left, right = align(np.cumsum(self.tok.a_size[flat_a]), np.cumsum(self.tok.b_size[flat_b]))
            keys = flat_a[left] << 32 | flat_b[right]
            n_links = np.bincount(np.repeat(np.arange(len(where)), n_a)[left], minlength=len(where))
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))[where])
            n_groups = np.bincount(np.searchsorted(ends, cuts), minlength=len(where))
            sizes[where] = np.column_stack([n_a, n_b[where], n_groups, n_links])
            # Each group as text, then each chunk's groups together.
            names_a, names_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
            to_a, to_b = (np.cumsum(np.bincount(g, minlength=len(cuts))).tolist() for g in (group_a, group_b))
            groups, p, r = [], 0, 0
            for q, s in zip(to_a, to_b):
                x = names_a[p] if q == p + 1 else ",".join(names_a[p:q])
                groups.append(f"{x}|{names_b[r]}" if s == r + 1 else f"{x}|{','.join(names_b[r:s])}")
                p, r = q, s
            p = 0
            for k, q in zip(where.tolist(), np.cumsum(n_groups).tolist()):
                texts[k] = groups[p] if q == p + 1 else ";".join(groups[p:q])
                p = q
        self.index.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.texts += texts
        self.bytes += sum(map(len, raw))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.keys = np.concatenate([self.keys, keys])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(sizes[:, 3])])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])

    def links(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the chunks, one chunk after the other, and how many each has."""
        n = self.sizes[used, 3]
        before = np.cumsum(n) - n
        return self.keys[np.repeat(self.ptr[used] - before, n) + np.arange(int(n.sum()))], n


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts in runs of about ``SLICE_BYTES``, with the row at which each run begins."""
    sizes = np.asarray(pc.binary_length(column.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE_BYTES, "right")))
        yield at, utf8(column.slice(at, to - at))
        at = to


def _chunked(texts: list[bytes | None], chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk ids, end of each document among them, whether the document has tokens)."""
    flat: list[str] = []
    ends = []
    for t in texts:
        if t:
            flat += _CUT.split(t.decode())
        ends.append(len(flat))
    ids, ends = chunks.ids(flat), np.array(ends, np.int64)
    bad = np.concatenate([[0], np.cumsum(chunks.sizes[ids, 0] < 0)])
    starts = np.concatenate([[0], ends[:-1]])
    return ids, ends, (ends > starts) & (bad[ends] == bad[starts])


def _digests(folder: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tokenizers(folder))
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                ids, ends, good = _chunked(texts, chunks)
                starts = np.concatenate([[0], ends[:-1]])
                summed = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(chunks.sizes[ids], axis=0)])
                sizes = np.where(good[:, None], summed[ends] - summed[starts], 0)
                text_of, numbers = chunks.texts, ids.tolist()
                digests = [
                    hashlib.sha256(";".join([text_of[k] for k in numbers[p:q]]).encode()).hexdigest() if g else ""
                    for p, q, g in zip(starts.tolist(), ends.tolist(), good.tolist())
                ]
                # The distinct links of each document: of the slice's links, numbered, those of one document after those of another.
                keys, n = chunks.links(ids[np.repeat(good, ends - starts)])
                links, number = np.unique(keys, return_inverse=True)
                doc = np.repeat(np.repeat(np.arange(len(texts)), np.where(good, ends - starts, 0)), n)
                pairs, times = np.unique(doc * max(1, len(links)) + number, return_counts=True)
                per_doc = np.bincount(pairs // max(1, len(links)), minlength=len(texts))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (links[pairs % max(1, len(links))], times.astype(np.int64))]
                columns = [b.column(0).slice(at, len(texts)), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return digest


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"


def pair_counts(each: DataFrame) -> DataFrame:
    """(key, n, best): how many links hold the two ids linked, and whether that is the highest count of the B id. ``each``: key, times."""
    salted = each.groupBy("key", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("n"))
    return salted.groupBy("key").agg(F.sum("n").alias("n"))


def with_best(pairs: DataFrame) -> DataFrame:
    b = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    # At most one row for each id of B's vocabulary.
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "token_alignment")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.save(slim.mapInArrow(_digests(folder), _ALIGNED).withColumn("row", F.monotonically_increasing_id()), "rows")
    each = rows.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), "times")))
    pairs = scratch.save(with_best(scratch.save(pair_counts(each), "counts")), "pairs")
    scored = each.join(bounded_broadcast(pairs, sent_pairs), "key")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = scored.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.drop("keys", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"
    )
