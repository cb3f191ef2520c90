"""MinHash near-duplicate groups with sequential Bayesian verification.

1. A sketch of each text's set of five-word shingles: its size, a 128-bit key of the whole set, ``BANDS``
   band keys of ``ROWS`` minima each, and one byte of each minimum. Documents with equal sets form a class; from
   here on its smallest doc_id stands for it, so copies are never compared.
2. Classes that share a band key are candidates. In the first round each is compared with the
   bucket's smallest and largest id only (a star, linear in the bucket's size).
3. A candidate pair's bytes are compared in batches. After each batch, the pair goes if the posterior probability that its
   similarity reaches the threshold (uniform prior) is below ``MISS``. Survivors are verified on the full sets.
4. In the second round, what is not in its bucket's largest component is compared with members of other components, so
   that no candidate link between components stays untested. Exact bounds come first. Every set's shingles are ranked by one global order: those of a
   single component, which no other can share, then the rarest. If x and y first meet in a shingle at the ranks p and q, they
   share at most min(|x| - p, |y| - q), of which a link needs 3/7 of |x| + |y| (similarity 0.75). So only a quarter of each set can
   bring a pair about, the common shingles of a large group of far copies bring none, and the join is on (shingle, class of set sizes).
5. Components of the verified links come from alternating large and small stars; ids that gather many links are joined apart.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**5)**48 = 2.3e-6; more similar pairs, less.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of fewer than five words
has one shingle, its whole sequence. Equal sets are one class whatever the texts. Repeated rows each give a
row; rows that share a doc_id are one document for linking. A row without a doc_id links nothing, but has the component of equal sets. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.llm.common import SIMILARITY, Scratch, bounded_broadcast, mix, multipliers, shingle_hashes, slices, unused, utf8

BANDS, ROWS = 48, 5
BATCH = 40
MISS = 1e-6
#: Shingles whose minima are taken at once; about what a core's cache holds.
BLOCK = 1 << 14
#: Ids of texts to verify that are broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: An id with more links than this, and than its share of all links at ``HOT_IDS`` such ids, meets its component in a broadcast.
HOT_LINKS = 500
HOT_IDS = 100_000

_FACTORS = multipliers(BANDS * ROWS, 20_011)
_BAND_FACTORS = multipliers(BANDS, 20_021)


def needed_matches(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """The fewest matches among n with which P(similarity >= threshold) is still ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each (non-empty) set under every permutation."""
    out = np.empty((len(sets), len(_FACTORS)), np.uint64)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= BLOCK):
            n += len(sets[last])
            last += 1
        h = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k, factor in enumerate(_FACTORS):
            out[first:last, k] = np.minimum.reduceat(h * factor, starts)
        first = last
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [np.unique(shingle_hashes((x or b"").lower().split())) for x in utf8(b.column(1))]
        some = [k for k, s in enumerate(sets) if len(s)]
        m = minima([sets[k] for k in some])
        bands = np.zeros((len(some), BANDS), np.uint64)
        for j in range(ROWS):
            bands = mix((bands ^ m[:, j::ROWS]) * _BAND_FACTORS)
        small = (mix(m) & np.uint64(255)).astype(np.uint8)
        keys: list[bytes | None] = [None] * len(sets)
        bytes_, band_lists = list(keys), list(keys)
        for row, k in enumerate(some):
            keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            bytes_[k] = small[row].tobytes()
            band_lists[k] = bands[row].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(bytes_, pa.binary()),
                pa.array(band_lists, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_key", "bytes", "bands"],
        )


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose bytes aren't pruned by the posterior bound at any batch."""
    for t in batches:
        left = np.arange(t.num_rows)
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (t.column(2), t.column(3)))
        matches = np.zeros(t.num_rows, np.int64)
        for at in range(0, BANDS * ROWS, BATCH):
            matches[left] += (x[left, at : at + BATCH] == y[left, at : at + BATCH]).sum(1)
            left = left[matches[left] >= needed_matches(at + BATCH)]
        yield pa.RecordBatch.from_arrays([t.column(k).take(pa.array(left)) for k in (0, 1)], names=["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = (np.unique(shingle_hashes((x or b"").lower().split())).tobytes() for x in utf8(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "set"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            h = np.unique(shingle_hashes((text or b"").lower().split())).view(np.int64)
            same = lambda x: pa.array(np.full(len(h), x, np.int64))
            yield pa.RecordBatch.from_arrays(
                [same(i), same(np.bitwise_xor.reduce(h) if len(h) else 0), same(len(h)), pa.array(h)], names=["id", "set", "n", "shingle"]
            )


def similar_sets(x: np.ndarray, y: np.ndarray, percent: int = round(100 * SIMILARITY)) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in slices(batches):
        x, y = t.column(2).to_pylist(), t.column(3).to_pylist()
        good = [similar_sets(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([t.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])


def _with_low(links: DataFrame, low: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The links (a, b) with the ``low`` of their a. Ids that gather more than their share of all links meet theirs in a
    broadcast, so that no task gets a whole large component; there are at most ``HOT_IDS`` of them."""
    low = scratch.save(low, name)
    total = low.agg(F.sum("n")).first()[0] or 0
    hot = low.where(F.col("n") > max(HOT_LINKS, total // HOT_IDS))
    if hot.isEmpty():
        return links.join(low.drop("n"), "a")
    rest = links.join(F.broadcast(hot.select("a")), "a", "left_anti")
    return rest.join(low.drop("n"), "a").unionByName(links.join(F.broadcast(hot.drop("n")), "a"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable, for every id with an edge. ``edges``: a, b long."""
    last, n = None, 0
    links = edges
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        large = _with_low(both, low, scratch, f"low{n}").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = scratch.save(large.where("a != b").distinct(), f"large{n}")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = (
            _with_low(large, low, scratch, f"least{n}")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
        )
        links = scratch.save(small.where("a != b").distinct(), f"small{n}")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for x in ("low", "large", "least"):
            scratch.drop(f"{x}{n}")
        if n:
            scratch.drop(f"small{n - 1}")
        if state == last:
            return links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        last, n = state, n + 1


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that hold on their full sets."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("bytes").alias(f"{c}_bytes"))
    maybe = scratch.save(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_bytes", "b_bytes")
        .mapInArrow(_plausible, "a long, b long"),
        f"maybe_{name}",
    )
    ids = maybe.select(F.col("a").alias("id")).union(maybe.select(F.col("b").alias("id"))).distinct()
    sets = scratch.save(_texts_of(ids, docs).mapInArrow(_full_sets, "id long, set binary").dropDuplicates(), f"sets_{name}")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set"))
    links = scratch.save(
        maybe.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set")
        .mapInArrow(_verified, "a long, b long"),
        f"links_{name}",
    )
    for x in ("maybe", "sets"):
        scratch.drop(f"{x}_{name}")
    return links


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(bounded_broadcast(ids, BROADCAST_IDS), docs["doc_id"] == ids["id"], "left_semi")


def _size_class(n: Column) -> Column:
    """Sizes within about 5 % of each other."""
    return F.floor(F.log(n) * 20).cast("int")


def _met_pairs(members: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ids of different components that the bounds of the second round leave. ``members``: id,
    component, apart (whether it is outside the largest component of some bucket); one of a pair is apart."""
    rows = _texts_of(members.select("id"), docs).mapInArrow(_shingle_rows, "id long, set long, n long, shingle long")
    rows = scratch.save(rows.join(members, "id"), "rows")
    common = (
        rows.groupBy("shingle")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("freq"))
        .select("shingle", F.when(F.col("first") == F.col("last"), 0).otherwise(F.col("freq")).alias("freq"))
    )
    rank = F.dense_rank().over(Window.partitionBy("id", "set").orderBy("freq", "shingle")) - 1
    ranked = scratch.save(
        rows.join(common, "shingle").withColumn("rank", rank).where("freq > 0 and 4 * (n - rank) >= 3 * n")
        .select("id", "component", "apart", "n", "rank", "shingle"),
        "ranked",
    )
    # The sizes that a set's partners in this shingle may have.
    least, most = F.expr("(3 * n + 3) div 4"), F.expr("(7 * (n - rank) - 3 * n) div 3")
    x = ranked.where("apart").where(most >= least).select(
        "shingle", F.explode(F.sequence(_size_class(least), _size_class(most))).alias("size_class"),
        F.col("id").alias("x"), F.col("component").alias("x_component"), F.col("n").alias("x_n"), F.col("rank").alias("x_rank"),
    )
    y = ranked.select("shingle", _size_class(F.col("n")).alias("size_class"), F.col("id").alias("y"), "component", "n", "rank")
    return (
        x.join(y, ["shingle", "size_class"])
        .where("component != x_component and 7 * least(n - rank, x_n - x_rank) >= 3 * (n + x_n)")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _ties(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id: they are one document."""
    some = sketches.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key")
    several = some.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high")
    held = some.join(several.select("doc_id"), "doc_id").distinct()
    return held.join(classes, "set_key").where("id is not null and id != doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and kept."""
    scratch = Scratch(docs.sparkSession, "near_dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.save(
        docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, bytes binary, bands array<long>"), "sketches"
    )
    # One row for each class: its smallest id; the sketch is the same for all of its members.
    classes = scratch.save(
        sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes"
    )
    heads = sketches.join(
        classes.withColumnRenamed("set_key", "head_key"), (F.col("set_key") == F.col("head_key")) & (F.col("doc_id") == F.col("id"))
    ).select("id", "n_shingles", "bytes", "bands").dropDuplicates(["id", "bytes"])
    keyed = heads.select("id", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = scratch.save(keyed.join(buckets, "band"), "members")
    active = members.select("id").distinct()
    compared = scratch.save(heads.select("id", "bytes").join(active, "id", "left_semi"), "compared")
    stars = members.select(F.col("low").alias("a"), F.col("id").alias("b")).union(
        members.select(F.col("id").alias("a"), F.col("high").alias("b"))
    )
    first = _links(stars.where("a < b").distinct(), compared, docs, scratch, "stars")
    parts = scratch.save(components(first, scratch), "parts")
    # What the stars leave apart inside a bucket.
    labelled = members.select("band", "id").join(parts, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    sizes = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    apart = labelled.join(mixed.select("band", F.col("main.component").alias("main")), "band")
    apart = apart.groupBy("id", "component").agg(F.bool_or(F.col("component") != F.col("main")).alias("apart"))
    second = _links(_met_pairs(scratch.save(apart, "apart"), docs, scratch), compared, docs, scratch, "rest")
    found = scratch.save(components(first.union(second).union(_ties(sketches, classes)), scratch), "components")
    for x in ("members", "compared", "apart", "rows", "ranked", "parts"):
        scratch.drop(x)
    named = classes.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    # Empty texts have no set; they would all meet on one null key.
    slim = sketches.select("doc_id", "n_shingles", "set_key")
    linked = slim.where("n_shingles > 0").join(named, "set_key").drop("set_key")
    alone = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return (
        linked.unionByName(alone)
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept document of each group with all its columns; of rows that share an id, one. Rows without an id stay."""
    scratch = Scratch(docs.sparkSession, "one_of_each")
    gone_id, twice_id, row = unused(docs, "_gone", "_twice", "_row")
    groups = scratch.save(near_duplicate_groups(docs, id_col, text_col).where("doc_id is not null"), "groups")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(bounded_broadcast(gone, BROADCAST_IDS), F.col(id_col) == F.col(gone_id), "left_anti")
    twice = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice_id))
    if twice.isEmpty():
        return kept
    same = F.col(id_col) == F.col(twice_id)
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    twice = bounded_broadcast(twice, BROADCAST_IDS)
    first = kept.join(twice, same, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return kept.join(twice, same, "left_anti").unionByName(first)
