"""The corpus operators on awkward rows, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquill.llm import (
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    queries,
    sharding,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, shard string, word string, id string, host string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None) -> set:
    w = split(text)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def awkward() -> list[tuple]:
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Ümlaut", "ÉCOLE", "x", "the", "of"]
    base = " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n\v", "one", "one two three", base, base, " ".join(near), base.upper(), "a b c d e f g h " * 3,
        "x" * 50_000, " ".join(f"w{rng.randrange(4000)}" for _ in range(60_000)), "Released under the MIT License. cc by nc cc by nc",
        "mail a@b.c_x@y.org, a.b@c..d@e.f 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111 +1 (614) 555-8001 é 10.0.0.1",
        "  \x85word \x1f", "12345 !!! 67", "tail\n\nsame\nsame\n same\nx y z x y z x y z",
    ]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("s1", "s2", None, "s1")[k % 4], 1, 9, "k", "s", "w", "i", "h") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0]]  # repeated rows
    rows += [(100 + k, base, "en", "hot", 1, 9, "k", "s", "w", "i", "h") for k in range(12)]  # a hot source of copies
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


# --- near duplicates ---------------------------------------------------------------------------------------


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("which", ["docs", "real"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want = components(texts)
    rows = near_dedup.near_duplicate_groups(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["component_id"] == want[r["doc_id"]]
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]]))
        assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    left = [r["doc_id"] for r in near_dedup.one_of_each(df).collect()]
    assert sorted(left) == sorted({i for i, c in want.items() if i == c})


def test_near_duplicates_of_a_star_and_a_chain(spark):
    """Far copies of one text, which only the second round can tell apart, and chains of links."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(140)]
    rows, chain = [], list(base)
    for k in range(150):
        w = list(base)
        for j in rng.sample(range(140), rng.choice([1, 3, 5, 8, 12])):
            w[j] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(150, 190):
        chain[rng.randrange(140)] = f"c{k}"
        rows.append((k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicate_groups(df).collect()}
    assert got == components(dict(rows))


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("alpha beta gamma delta one", "red green blue black white", "up down left right back")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, None), (9, c), (9, c), (3, c), (None, b), (20, ""), (20, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicate_groups(df).collect())
    assert found == collections.Counter([
        (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 7, True), (9, 3, False), (9, 3, False), (3, 3, True), (None, 1, False), (20, 20, True), (20, 3, False),
    ])


def test_components_do_not_depend_on_what_is_hot(spark, monkeypatch):
    """A hub of many members, a chain through it and pairs apart, with hubs joined by a broadcast and without."""
    monkeypatch.setattr(near_dedup, "HOT_IDS", 1_000)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(59, 75)] + [(100 + k, 200 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {k: 0 for k in range(76)} | {x + k: 100 + k for k in range(30) for x in (100, 200)}
    for most in (2, 1_000):
        monkeypatch.setattr(near_dedup, "HOT_LINKS", most)
        found = near_dedup.components(df, near_dedup.Scratch(spark, "hot")).collect()
        assert {r["id"]: r["component"] for r in found} | {x: x for x in (0, *range(100, 130))} == want


def test_bayes_bound():
    for n in (40, 120, 240):
        m = near_dedup.needed_matches(n)
        tail = lambda k: sum(math.comb(n + 1, j) * 0.75**j * 0.25 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= near_dedup.MISS > tail(m - 1)


# --- decontamination -----------------------------------------------------------------------------------------


def test_blocks_of_items_are_all_searched(spark, real, monkeypatch):
    """Many small blocks, of which one index is alive at a time, find and leave the same; items of all blocks together are all items."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(tuple(r) for r in decontamination.contamination(real, items).collect())
    left = sorted(r["doc_id"] for r in decontamination.clean(real, items).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30_000)
    blocks = [b for b, _ in decontamination._with_last(decontamination.item_blocks(items, "item_id", "text"))]
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == sorted(r["item_id"] for r in items.collect())
    assert sorted(tuple(r) for r in decontamination.contamination(real, items).collect()) == want
    assert sorted(r["doc_id"] for r in decontamination.clean(real, items).collect()) == left


def test_decontamination(spark, docs, real):
    texts = [(i, r["text"]) for i, r in enumerate(docs.where("text is not null").limit(9).collect())]
    long_text = by_id(docs)[11]["text"]
    items = texts + [(90, " ".join(long_text.split()[30_000:30_030])), (91, "one two three"), (92, None), (93, ""), (94, "nowhere to be found at all in here")]
    items = spark.createDataFrame(items, "item_id long, text string")
    for d, it in ((docs, items), (real, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        rows = [(r["doc_id"], r["text"]) for r in d.collect()]
        want = collections.Counter()
        sets = [(i, split(t), shingles(t)) for i, t in rows]
        for r in it.collect():
            q, w = shingles(r["text"]), split(r["text"])
            for i, words, s in sets:
                if not q:
                    continue
                if len(w) < 5:
                    s = {tuple(words[j : j + len(w)]) for j in range(len(words) - len(w) + 1)}
                if len(q & s) >= 0.75 * len(q):
                    want[i, r["item_id"]] += 1
        found = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.contamination(d, it).collect())
        assert found == want
        bad = {i for i, _ in want}
        left = [r["doc_id"] for r in decontamination.clean(d, it).collect()]
        assert sorted(left) == sorted(i for i, _ in rows if i not in bad)


# --- sharding ------------------------------------------------------------------------------------------------


def test_sharding(docs, real):
    for d in (docs, real):
        rows = sharding.assign_shards(d, 8).collect()
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        assert len(rows) == d.count()
        slots, shards, sizes = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
        for r in rows:
            t = texts[r["doc_id"]]
            assert r["size"] == len((t or "").encode()) + 1
            assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
            slots[r["shard"]].append(r["slot"])
            shards[t].add(r["shard"])
            sizes[r["shard"]] += r["size"]
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert all(len(x) == 1 for x in shards.values())
        assert set(sizes) <= set(range(8))


def test_smallest_capacity_is_exact():
    rng = random.Random(2)

    def brute(sizes, k):
        def fits(c):
            n, room = 1, c
            for x in sizes:
                if x > room:
                    n, room = n + 1, c
                room -= x
            return n <= k

        low, high = max(sizes), sum(sizes)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid) else (mid + 1, high)
        return low

    for trial in range(60):
        n, k = rng.choice([1, 5, 60, 300]), rng.choice([2, 3, 8])
        sizes = [rng.choice([1, 7, rng.randint(1, 900)]) for _ in range(n)]
        if trial % 3 == 0:
            sizes[rng.randrange(n)] = 9000
        places = sorted(rng.sample(range(-(2**12), 2**12), n))
        groups = list(zip(places, sizes))

        def ranges(part, bits):
            found = collections.defaultdict(list)
            for p, s in part:
                found[p >> bits].append(s)
            return [sharding.Range(h << bits, bits, sum(v), max(v)) for h, v in found.items()]

        now = sorted(ranges(groups, 10), key=lambda r: r.start)
        while True:
            least, most, todo = sharding.capacity_bounds(now, k)
            if not todo:
                break
            wide = max(now[j].bits for j in todo)
            chosen = {j for j in todo if now[j].bits == wide}
            finer = [r for j in chosen for r in ranges([g for g in groups if now[j].start <= g[0] < now[j].start + (1 << wide)], max(0, wide - 3))]
            now = sorted([r for j, r in enumerate(now) if j not in chosen] + finer, key=lambda r: r.start)
        assert least == most == brute(sizes, k)


# --- mixing --------------------------------------------------------------------------------------------------


def test_mixing(docs, real):
    for d in (docs, real):
        rows = mixing.mix_sources(d).collect()
        assert sorted(rows) == sorted(mixing.mix_sources(d).collect())
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        taken, target, size = collections.Counter(), {}, collections.Counter()
        for r in rows:
            assert r["size"] == len(split(texts[r["doc_id"]]))
            assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[r["source"]] += r["taken"]
            size[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
        assert size == collections.Counter({r["source"]: r["source_size"] for r in rows})
        assert target == pytest.approx(mixing.fair_targets(dict(size)))
        for s in target:  # whole copies of the source, then as near from below as its documents, each once more, can come
            goal = round(target[s])
            base = min(goal // size[s], 2) * size[s] if size[s] else 0
            reach = 1
            for r in rows:
                if r["source"] == s:
                    reach |= reach << r["size"]
            best = base + (reach & ((1 << goal - base + 1) - 1)).bit_length() - 1
            assert best - goal / 1000 <= taken[s] <= goal
        out = collections.Counter(r["doc_id"] for r in mixing.expand_mix(d, mixing.mix_sources(d)).collect())
        want = collections.Counter()
        for r in rows:
            want[r["doc_id"]] += r["copies"]
        assert out == +want


def test_fair_targets_and_knapsack():
    t = mixing.fair_targets({"a": 10, "b": 1000, None: 100})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(1.5 * 1110) and t[None] == 200
    assert mixing.fair_targets({}) == {}
    rng = random.Random(6)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 200), rng.randint(1, 12))), np.int64)
        counts = np.array([rng.randint(1, 9) for _ in lengths], np.int64)
        budget = rng.randint(0, int((lengths * counts).sum()) + 5)
        take = mixing.fit_budget(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        best = max(r for r in reach if r <= budget)
        assert best - (take * lengths).sum() <= max(4 * lengths.max(), 1) and (take * lengths).sum() <= budget


# --- quality rules --------------------------------------------------------------------------------------------


def plain_prior(groups: list[tuple[int, float]], q: float | None = None) -> tuple[float, float]:
    """The prior's mean and averaged weight, by loops and math.lgamma."""
    total, failed = (sum(g[k] for g in groups) for k in (0, 1))
    k = len(groups)
    mean, weight = min(max(failed / total, 1e-6), 1 - 1e-6), 1e15
    if k > 1 and total > k:
        within = max((failed if q is None else q) - sum(f * f / n for n, f in groups), 0) / (total - k)
        typical = (total - sum(n * n for n, _ in groups) / total) / (k - 1)
        scale = min(max(mean * (1 - mean) / within if within else 1, 1), 1e4)
        values, factors = [], [(j + 0.5) / 64 for j in range(64)]
        for b in factors:
            w = typical * scale * b / (1 - b)
            g = math.lgamma
            values.append(sum(g(scale * f + mean * w) - g(mean * w) + g(scale * (n - f) + (1 - mean) * w) - g((1 - mean) * w) - g(scale * n + w) + g(w) for n, f in groups))
        chance = [math.exp(v - max(values)) for v in values]
        shrunk = sum(c * b for c, b in zip(chance, factors)) / sum(chance)
        weight = typical * shrunk / (1 - shrunk)
    mean = sum(f / (n + weight) for n, f in groups) / sum(n / (n + weight) for n, f in groups)
    return min(max(mean, 1e-6), 1 - 1e-6), weight


def test_quality_rules(docs, real):
    for d in (docs, real):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        rows = quality_rules.host_quality_rules(d).collect()
        assert len(rows) == d.count()
        for r in rows:
            t = texts[r["doc_id"]] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
            inside = {j + i for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for i in range(3)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])
            n_lines = len(lines)
            shares = [len(re.findall(r"[#*$%&|<>]", t)) / (0.1 * len(w)), abs(sum(map(len, w)) / len(w) - 7.5) / 4.5, (n_lines - len(set(lines))) / (0.3 * n_lines)] if w else [2]
            assert r["margin"] == pytest.approx(max(shares)) and r["soft_failed"] == (r["base_failed"] or max(shares) > 1)
        # Rates, shifts and verdicts by plain sums, with the prior as found.
        hosts = collections.defaultdict(list)
        for r in rows:
            hosts[r["host"]].append(r)
        mean, weight = plain_prior([(len(v), sum(x["soft_failed"] for x in v)) for v in hosts.values()])
        for v in hosts.values():
            for r in v:
                rate = (sum(x["soft_failed"] for x in v) - r["soft_failed"] + weight * mean) / (len(v) - 1 + weight)
                assert r["host_rate"] == pytest.approx(rate, rel=1e-6)
                odds = 10 * (r["margin"] - 1) + math.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
                assert abs(odds) < 1e-6 or r["kept"] == (not r["base_failed"] and odds <= 0)


def test_bad_hosts_lose_soft_failures(spark):
    good, soft = " ".join(f"word{k}" for k in range(80)), " ".join(f"word{k}#####" for k in range(80))
    near = good + " " + "#" * 9  # a little beyond the threshold
    rows = [(k, soft, "bad") for k in range(60)] + [(100, good, "bad"), (101, near, "bad")] + [(200 + k, good, "fine") for k in range(200)] + [(500, near, "fine"), (501, soft, "fine")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.host_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[k] for k in range(60)) and kept[100] and kept[500] and kept[200] and not kept[101] and not kept[501]


def test_hosts_of_one_document_are_not_judged_by_it(spark):
    good, soft = " ".join(f"word{k}" for k in range(80)), " ".join(f"word{k}#####" for k in range(80))
    rows = [(k, soft if k % 2 else good, f"host{k}") for k in range(600)]
    found = quality_rules.host_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {round(r["host_rate"], 6) for r in found} == {0.5} and {round(r["host_shift"], 6) for r in found} == {0.0}


def test_verdicts_of_hosts_planted_among_the_documents(spark):
    """Among the tables' sources, a host of failures and one that hardly has any; only what is near a rule changes its verdict."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = by_id(quality_rules.host_quality_rules(real))
    assert len({round(r["host_rate"], 4) for r in before.values()}) > 10  # sources have rates of their own
    failed = sorted(i for i, r in before.items() if r["soft_failed"] and not r["base_failed"])
    plain = sorted(i for i, r in before.items() if not r["soft_failed"])
    text = lambda n: " ".join(f"word{k}" for k in range(100)) + " " + "#" * n  # noqa: E731  10.1 symbols are allowed
    site = F.when(F.col("doc_id").isin(failed[:40] + plain[:20]), "bad").when(F.col("doc_id").isin(plain[20:320]), "good").otherwise(F.col("source"))
    more = spark.createDataFrame([(-k - 10 * h, text(n), s) for h, s in enumerate(("bad", "src3", "good")) for k, n in ((1, 1), (2, 9), (3, 12))], "doc_id long, text string, source string")
    rows = by_id(quality_rules.host_quality_rules(real.select("doc_id", "text", site.alias("source")).union(more)))
    assert rows[-1]["host_shift"] > 1 > 0.3 > abs(rows[-11]["host_shift"]) and rows[-21]["host_shift"] < -1.9
    assert [[rows[-k - 10 * h]["kept"] for k in (1, 2, 3)] for h in (0, 1, 2)] == [[True, False, False], [True, True, False], [True, True, True]]
    # What is beyond doubt keeps its verdict on every host.
    assert all(rows[i]["kept"] == before[i]["kept"] for i in before if before[i]["base_failed"] or abs(before[i]["margin"] - 1) > 0.6)


def test_prior_is_averaged_over_its_weight(spark):
    """Groups drawn with one rate are shrunk nearly wholly, unlike ones little; the weight is that of plain sums, and never infinite."""
    from terraquill.llm import shrinkage

    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 4000)
    for p, mean, low, high in ((np.full(4000, 0.3), 0.3, 50, 1e4), (rng.beta(3, 7, 4000), 0.3, 7, 14), (np.full(4000, 0.0), 0.0, 1, 1e4)):
        f = rng.binomial(n, p)
        rows = spark.createDataFrame([(int(a), float(b), float(b)) for a, b in zip(n, f)], "n long, f double, q double")
        found = shrinkage.prior(rows)
        assert found == pytest.approx(plain_prior(list(zip(n.tolist(), f.tolist()))), rel=1e-4)
        assert found[0] == pytest.approx(mean, abs=0.02) and low < found[1] < high
    assert shrinkage.prior(rows.where("n > 99")) == (0.5, shrinkage.NO_SPREAD)
    assert shrinkage.prior(rows.limit(1))[1] == shrinkage.NO_SPREAD == shrinkage.prior(rows.where("n = 1"))[1]
    # Outcomes between 0 and 1: twenty groups of 500 that hardly differ still have rates of their own.
    x = rng.beta(0.3, 1.7, (20, 500)) + rng.normal(0, 0.004, 20)[:, None]
    rows = spark.createDataFrame([(500, float(v.sum()), float((v * v).sum())) for v in x], "n long, f double, q double")
    mean, weight = shrinkage.prior(rows)
    assert (mean, weight) == pytest.approx(plain_prior([(500, float(v.sum())) for v in x], float((x * x).sum())), rel=1e-4) and weight < 50_000


# --- license, PII ---------------------------------------------------------------------------------------------


def test_license_scan(docs, real):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for d in (docs, real):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        rows = license_scan.license_scan(d).collect()
        assert len(rows) == d.count()
        for r in rows:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate(LOWER))
            at = [(j, label) for label, p in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
            assert (r["n_words"], r["n_base"]) == (len(w), len(at))
            assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert 0 <= r["score"] <= 1


def template(label: str, k: int = 0) -> str:
    return [text for name, text in license_scan.TEMPLATES if name == label][k]


def test_license_notice_with_words_left_out(spark):
    words = template("mit").split()
    text = "some code here " + " ".join(words[:12] + words[13:]) + " the end"
    row = license_scan.license_scan(spark.createDataFrame([(1, text), (2, "all rights")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0]["labels"], row[0]["base_labels"], row[1]["labels"]) == ("mit", "", "")


def test_license_notices_repeated_or_chained_by_strays(spark):
    gpl = template("gpl").split()
    part = " ".join(gpl[:14] + gpl[15:])
    texts = ["All rights reserved. All rights reserved.", "All rights reserved.\n" * 5, f"{part} {part}", "x all rights reserved y"]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["all-rights-reserved", "all-rights-reserved", "gpl", "all-rights-reserved"]
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in rows] == [[(0, 3), (3, 6)], [(3 * k, 3 * k + 3) for k in range(5)], [(0, 28), (28, 56)], [(1, 4)]]


def brute_notices(words: list[str]) -> list[tuple[int, int, str]]:
    """Votes, runs, merged spans and the best of those that overlap, by plain loops."""
    spans = []
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        t = text.split()
        n_grams = len(t) - 2
        places = collections.defaultdict(list)
        for q in range(n_grams):
            for p in range(len(words) - 2):
                if words[p : p + 3] == t[q : q + 3]:
                    places[p - q].append(q)
        runs = []
        for d, qs in places.items():
            run = [qs[0]]
            for q in [*qs[1:], 10**9]:
                if q - run[-1] > license_scan.MAX_HOLE:
                    runs.append((run[0], d + run[0], run[-1], d + run[-1] + 3, len(run), d, run))
                    run = []
                run.append(q)
        for first, start, last, end, n, d, held in runs:
            for f2, s2, l2, e2, n2, d2, h2 in sorted(r for r in runs if r[1] >= start and r[3] <= start + license_scan.MAX_STRETCH * len(t)):
                if f2 > last and s2 > end - 3 and abs(d2 - d) <= license_scan.MAX_SHIFT:
                    last, end, n, d, held = l2, e2, n + n2, d2, held + h2
            if not (n >= license_scan.MIN_COVER * n_grams or (n >= license_scan.MIN_RUN and n >= license_scan.MIN_COVER * (end - start - 2))):
                continue
            mine = {tuple(t[q : q + 3]) for q in range(n_grams)}
            own = []  # for each sibling, what only this template has
            for name, other in license_scan.TEMPLATES:
                theirs = {tuple(other.split()[q : q + 3]) for q in range(len(other.split()) - 2)}
                at = [q for q in range(n_grams) if tuple(t[q : q + 3]) not in theirs]
                if name != label and at and mine and n_grams - len(at) >= 0.4 * n_grams:
                    own.append(at)
            if all(len(set(at) & set(held)) >= (len(at) if len(at) <= 4 else 0.6 * len(at)) for at in own):
                spans.append((-n, start, k + len(license_scan.BASE_PHRASES), end, label))
    kept = []
    for _, start, _, end, label in sorted(spans):
        if all(b <= start or end <= a for a, b, _ in kept):
            kept.append((start, end, label))
    return sorted(kept)


SIBLINGS = {
    "Licensed under the GNU General Public License version 2": "gpl-2",
    "Licensed under the GNU General Public License, Version 3.": "gpl-3",
    "licensed under the GNU General Public License version 1": "",
    "Licensed under the GNU Lesser General Public License version 3": "lgpl-3",
    "Licensed under the GNU Affero General Public License version 3": "agpl-3",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.": "",
    "// SPDX-License-Identifier: MIT\nint main": "mit",
    "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
    "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
    "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
    "# SPDX-License-Identifier: WTFPL": "",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,": "agpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl,lgpl-2",
}


def test_siblings_are_told_apart(spark):
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(SIBLINGS)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, (text, label) in zip(rows, SIBLINGS.items()):
        names = set(r["labels"].split(",")) - {""}
        allowed = set(label.split(",")) - {""}
        assert names <= allowed and (names or not allowed), (text, names)


def test_every_template_has_its_own_label_only(spark):
    """Each pair of siblings: the text of one never has the other's label."""
    rows = license_scan.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {k: label for k, (label, _) in enumerate(license_scan.TEMPLATES)}


def test_license_notices_against_brute_force(spark):
    """Every template whole, twice in a row, cut to half, with words lost, put in and changed, and interleaved with others."""
    rng = random.Random(9)
    texts = []
    for label, text in license_scan.TEMPLATES:
        w = text.split()
        lost = [x for x in w if rng.random() > 0.06]
        more = [y for x in w for y in ([x, "zz"] if rng.random() < 0.05 else [x])]
        other = rng.choice(license_scan.TEMPLATES)[1].split()
        texts += [text, f"{text} {text}", " ".join(w[len(w) // 2 :]), " ".join(lost), " ".join(more), " ".join(w[:9] + other + w[9:]), " ".join(w[::-1])]
        texts.append(f"a {text} and {' '.join(other[: len(other) * 3 // 4])} " * 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_scan(docs).collect():
        want = brute_notices(texts[r["doc_id"]].split())
        assert [(s["start"], s["end"], s["label"]) for s in r["spans"] or []] == want, texts[r["doc_id"]]
    whole = {r["doc_id"] // 8: r["labels"] for r in license_scan.license_scan(docs.where("doc_id % 8 = 0")).collect()}
    assert all(label in whole[k].split(",") for k, (label, _) in enumerate(license_scan.TEMPLATES))
    nc = whole[[label for label, _ in license_scan.TEMPLATES].index("cc-by-nc")]
    assert nc == "cc-by-nc"  # not cc-by, whose words it holds too


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str | None) -> list[str]:
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and luhn,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, real):
    rng = random.Random(1)
    bits = ["a@b.co", "@", "..", ".", "x_y", "1.2.3.4", "0255.1", "999", "4111111111111111", "4111-1111 1111 1111", "+1 ", "(614)", "-", " ", " ", "5558001", "é", "\n", "a.b@c-d.e.f"]
    odd = spark.createDataFrame([(k, "".join(rng.choices(bits, k=30))) for k in range(300)], "doc_id long, text string")
    many = spark.createDataFrame([(1, "1.2.3.4 x@y.zz " * 700)], "doc_id long, text string")
    for d in (docs, real, odd, many):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        rows = pii.find_pii(d).collect()
        assert len(rows) == d.count()
        for r in rows:
            want = base_spans(texts[r["doc_id"]])
            assert r["base_spans"] == want, texts[r["doc_id"]]
            assert [r[f"n_{k}"] for k in RULES] == [sum(x.startswith(k) for x in want) for k in RULES]


def test_pii_contexts_find_what_rules_miss(spark):
    rng = random.Random(2)
    texts = [f"please call the desk under mail user{k}@mail.example.org for help" for k in range(30)]
    texts += ["please call the desk under mail user77(at)mail.example.org for help", "there were user5(at)x people in 2019 and 44123 more"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    start = texts[30].index("user77")
    assert rows[30]["context_spans"] == [f"context:{start}:{start + len('user77(at)mail.example.org')}"]
    assert rows[31]["context_spans"] == [] and rng


def test_pii_contexts_over_candidates_side_by_side(spark):
    texts = [f"please call desk 7 under {k} user{k}@mail.example.org for help" for k in range(30)]
    texts.append("please call desk 7 under 24 user77(at)host9")
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    start = texts[30].index("user77")
    assert rows[30]["context_spans"] == [f"context:{start}:{start + len('user77(at)host9')}"]


def test_pii_left_contexts(spark):
    from terraquill.llm.common import Scratch

    rng = random.Random(3)
    texts = [" \n"[k % 2].join(rng.choices(["a1", "22", "(3)", "b", "cc", "x@y", "d,"], k=12)) for k in range(60)]
    spans = pii.spotted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t"))
    for r in spans.collect():
        text = texts[r["doc_id"]]
        tokens = list(re.finditer(r"(?:(?<!\S)[().+-]*\d[\d().+-]*(?:\x20[().+-]*\d[\d().+-]*(?!\S)){1,5})|\S*[0-9@]\S*", text))
        assert [(c["start"], c["text"]) for c in r["cand"]] == [(m.start(), m[0]) for m in tokens]
        for c, m in zip(r["cand"], tokens):
            assert c["before"] == text[: m.start()].split()[-2:]
            assert c["after"] == (text[m.end() :].split() or [None])[0]


def context_texts(spark, texts: list[str]) -> list[list[str]]:
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    ends = [[tuple(map(int, x.split(":")[1:])) for x in r["context_spans"]] for r in rows]
    return [[t[a:b] for a, b in e] for t, e in zip(texts, ends)]


def test_pii_contexts_of_secrets_and_parted_numbers(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    known = [f'w{k % 3} token = "{key()}" and more' for k in range(12)] + [f"ring me on +1 (614) 555-80{k} today" for k in range(10, 30)]
    known += [f"api_key={key()} is set" for k in range(12)] + [f"x api_key={key()}" for k in range(12)]
    shout, lone, plain = f'TOKEN = "{key().upper()}"!!', key(), "AKIA0123-QQ"
    unseen = [shout, f"w token = {plain}.", "ring me on 614 555 8001", f"the sum {lone} of a file", f"here api_key='{plain}'"]
    clean = ["in 2019 there were 44123 people", "version 2.0 of level 17", "ring me on Monday", "token = none", ""]
    found = context_texts(spark, known + unseen + clean)
    assert found[len(known) : len(known) + 5] == [[shout[9:49]], [plain], ["614 555 8001"], [], [plain]]
    assert found[len(known) + 5 :] == [[]] * 5
    assert all(x for x in found[:12])  # seeds of secrets are spans where a pattern holds them


def test_pii_contexts_on_documents(spark):
    """The planted secrets, which no base rule finds, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(i, f"context:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', t or "", re.I)}
    assert len(want) > 10
    assert {(r["doc_id"], x) for r in pii.find_pii(docs).collect() for x in r["context_spans"]} == want


def test_pii_scores_count_support(spark):
    """Few known instances, or many unknown ones, make no pattern."""
    few = [f"ask for u{k}@x.org now" for k in range(4)] + ["ask for 4711-9"]
    mixed = [f"sent by u{k}@x.org now" for k in range(9)] + [f"sent by 4711-{k} now" for k in range(9)]
    assert context_texts(spark, few + mixed) == [[]] * len(few + mixed)


# --- models -----------------------------------------------------------------------------------------------------


def test_lm_scores(docs, real):
    for d in (docs, real):
        rows = d.collect()
        tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in rows}
        fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
        counts = collections.Counter(t for r in rows if not fold(r["doc_id"]) for t in tokens[r["doc_id"]])
        n, v = sum(counts.values()), len(counts)
        found = lm_scoring.class_scores(d).collect()
        assert len(found) == len(rows)
        for r in found:
            t = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), n)
            assert r["held_out"] == fold(r["doc_id"])
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t))
            assert r["score"] < 0 and math.isfinite(r["score"])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(3)
    pairs = np.zeros((lm_scoring.N_UNITS, lm_scoring.N_UNITS))
    for a in range(20):  # two kinds of words that follow each other
        for b in range(20):
            pairs[a, b] = rng.poisson(200 if (a < 10) != (b < 10) else 1)
    of = lm_scoring.exchange_classes(pairs, classes=3)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]
    assert list(of).count(2) == 1 and of[lm_scoring.HEAD] == 2


def test_class_model_sums_to_one(spark):
    docs = spark.createDataFrame([(k, "a b a c " * (k % 3 + 1)) for k in range(40)], "doc_id long, text string")
    from terraquill.llm.common import Scratch

    model, counts = lm_scoring.train(docs, Scratch(spark, "t"))
    assert np.allclose((10**model.transition).sum(1), 1)
    mass = collections.Counter()
    for r in counts.collect():
        w = bytes(r["word"])
        c = model.class_of[model.units[w]]
        mass[c] += (r["n"] + 1) / model.class_tokens[c]
    for c, m in mass.items():  # what is left is the share of words never seen
        assert m + 1 / model.class_tokens[c] == pytest.approx(1)


def test_rare_words_have_classes_of_their_own_contexts(spark):
    """Words below the head with one ending and two kinds of contexts don't share a class."""
    from terraquill.llm.common import Scratch

    rng = random.Random(7)
    x, y = ([f"{s}{k}" for k in range(560)] for s in "xy")
    texts = []
    for k in range(1200):
        a, b = f"a{k % 300}_zz", f"b{k % 300}_zz"
        words = [rng.choice((x, y)[j % 2]) for j in range(16)]
        words[6], words[11] = a, b  # one stands where an x stands, one where a y does
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, words = lm_scoring.train(docs, Scratch(spark, "t"))
    of = {bytes(r["word"]).decode(): r["class"] for r in words.collect()}
    kinds = [collections.Counter(of[f"{s}{k}_zz"] for k in range(300)) for s in "ab"]
    assert sum((kinds[0] & kinds[1]).values()) < 30
    assert len(of) == len({w for t in texts for w in t.split()}) + 1


def test_classes_do_not_depend_on_what_travels(real, monkeypatch):
    whole = sorted(lm_scoring.class_scores(real).collect())
    monkeypatch.setattr(lm_scoring, "CACHED", lm_scoring.HEAD + 100)
    for a, b in zip(whole, sorted(lm_scoring.class_scores(real).collect()), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_language(docs, real):
    found = by_id(language_id.identify(docs, language_id.train(docs)))
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == found[15]["lang_pred"] == "und"
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in found.values())
    rows = language_id.identify(real, language_id.train(real)).collect()
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    none = by_id(language_id.identify(docs, language_id.train(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null"))))
    assert {r["lang_pred"] for r in none.values()} == {"und"}
    assert language_id.accepted(docs, language_id.train(docs)).columns == docs.columns


#: Other languages, code, keys and keyboard noise.
FOREIGN = (
    "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób",
    "Bütün mutlu aileler birbirine benzer, her mutsuz aile kendine göre mutsuzdur ve bu böyle sürer gider",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему",
    "Όλες οι ευτυχισμένες οικογένειες μοιάζουν μεταξύ τους, κάθε δυστυχισμένη οικογένεια",
    "幸福な家庭はすべて互いに似かよったものであり、不幸な家庭はどこもその不幸のおもむきが異なっているものである",
    "qwrtp zxcvb plkjh mnbvc xzqwk jhgfd wqzxj kjhgf vbnmz xcvqw ptrwq zzxxc",
    "4f2a9c81b7e3 0d6655aa91c7 bbee01f3a9d2 77c0e4d1f2b8 a1b2c3d4e5f6 09f8e7d6c5b4",
    "def f(x): return [y*2 for y in x if y%3==0]; import sys; print(f(range(10)))",
    "SGVsbG8gd29ybGQhIFRoaXMgaXMgYmFzZTY0IGVuY29kZWQgdGV4dC4gUGxlYXNlIGRlY29kZSBpdA==",
)


def test_language_rejects_what_is_none(spark):
    """Foreign and random texts go, documents stay, and the stage acts on it."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(real)
    rows = language_id.identify(real, model).collect()
    assert sum(r["rejected"] for r in rows) <= 0.002 * len(rows)
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert len({round(r["score"], 3) for r in rows}) > 20  # scores tell texts apart
    odd = spark.createDataFrame([(-k, t, None, "web", 1) for k, t in enumerate(FOREIGN, 1)], real.schema)
    kept = {r["doc_id"] for r in language_id.accepted(real.union(odd), model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if not r["rejected"]}


def test_language_sample_is_the_same_for_reruns_and_repeated_ids(spark, real, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_TRAIN", 12)
    twice = real.union(real.withColumn("text", F.reverse("text"))).union(real)
    models = [language_id.train(df) for df in (twice, twice.repartition(7), twice.orderBy("n_chars"))]
    assert all(np.array_equal(m.table, models[0].table) and m.least == models[0].least for m in models)


def test_quality(spark, docs, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = by_id(quality_classifier.classify(real, labels))
    assert len(rows) == real.count()
    marks = labels.collect()
    right = sum((rows[r["doc_id"]]["bad"] < 0.5) == (r["quality"] == 1) for r in marks if r["doc_id"] in rows)
    assert right >= 0.93 * len(marks)
    none = spark.createDataFrame([], labels.schema)
    assert all(r["kept"] for r in quality_classifier.classify(docs, none).collect())
    odd = spark.createDataFrame([(5, 1, 0), (7, 0, None), (12, None, 1), (None, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, odd).count() == docs.count()


def test_quality_of_held_out_labels(spark):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = {r["doc_id"]: r for r in labels.where("doc_id % 4 = 1").collect()}
    rows = by_id(quality_classifier.classify(real, labels.where("doc_id % 4 <> 1")))
    right = sum((rows[i]["bad"] < 0.5) == (r["quality"] == 1) for i, r in held.items())
    assert right >= 0.95 * len(held) and len(held) > 600
    toxic = [r["toxic"] for r in held.values()]
    assert sum(rows[i]["toxic"] >= 0.5 for i, r in held.items() if r["toxic"]) >= 0.92 * sum(toxic)
    assert sum(rows[i]["toxic"] >= 0.5 for i, r in held.items() if not r["toxic"]) <= 0.01 * len(held)


def test_sites_move_documents(spark):
    """On a bad host, documents in doubt go; elsewhere they stay; documents beyond doubt never move."""
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = by_id(quality_classifier.classify(real, labels))
    bad = sorted((i for i, r in plain.items() if r["evidence"] > 0.9))[:60]
    doubt = sorted(plain, key=lambda i: abs(plain[i]["evidence"] - 0.4))[:3]
    clean = [i for i, r in plain.items() if r["evidence"] < 0.001][:5]
    site = F.when(F.col("doc_id").isin(bad + doubt + clean), F.lit("http://Bad.example/x/1")).otherwise(F.concat("source", F.lit("/a")))
    rows = by_id(quality_classifier.classify(real.withColumn("source", site), labels))
    moved = [i for i in rows if rows[i]["kept"] != plain[i]["kept"]]
    assert not any(rows[i]["kept"] for i in doubt) and all(rows[i]["kept"] == plain[i]["kept"] for i in clean)
    assert set(doubt) & set(moved) and len(moved) < 0.02 * len(rows)
    assert rows[bad[0]]["site_rate"] > 0.5 > 0.3 > rows[next(i for i in rows if i not in bad + doubt + clean)]["site_rate"]


def test_sites_shrink(spark):
    from terraquill.llm.common import Scratch

    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.1)] * 300 + [("small", "a", 1.0)] + [("other", None, 0.2)] * 300 + [(None, None, 0.5)]
    rated, rate = quality_classifier.with_site_rates(spark.createDataFrame(rows, "host string, path string, bad double"), Scratch(spark, "t"))
    assert rated.count() == len(rows)
    found = {(r["host"], r["path"]): r["site_rate"] for r in rated.collect()}
    assert found["big", "a"] > 0.7 and found["big", "b"] < 0.3 and found["small", "a"] == pytest.approx(rate) == pytest.approx(found[None, None])
    urls = ["https://A.example/p/q?x", "a.example", "src1", "a/b", "a//b/c", None, ""]
    parts = spark.createDataFrame([(u,) for u in urls], "u string").select(*quality_classifier.site_parts(F.col("u"))).collect()
    assert [tuple(r) for r in parts] == [("a.example", "p"), ("a.example", None), ("src1", None), ("a", "b"), ("a", "b"), (None, None), ("", None)]


def test_many_groups_are_joined_without_one_task_of_the_hot_one(spark, monkeypatch):
    from terraquill.llm import shrinkage

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, null, concat('h', id))) host")
    groups = rows.groupBy(F.col("host").alias("g")).agg(F.count("*").alias("n"))
    want = sorted((r["id"], r["n"]) for r in shrinkage.join_groups(rows, groups, {"host": "g"}, "n").collect())
    monkeypatch.setattr(shrinkage, "BROADCAST_SITES", 10)
    assert sorted((r["id"], r["n"]) for r in shrinkage.join_groups(rows, groups, {"host": "g"}, "n").collect()) == want and len(want) == 3000


def test_null_ids(spark):
    """Rows without an id are told apart by their texts, and each is in the result."""
    rows = [(None, f"some words of text {k} and more {k}", "a") for k in range(60)] + [(None, None, None), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = sharding.assign_shards(df, 4).collect()
    assert len(placed) == 62 and all(sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed))) for s in range(4))
    mixed = mixing.mix_sources(df)
    assert mixed.count() == 62 and sum(r["taken"] for r in mixed.collect()) == round(1.5 * 60 * 8)
    groups = near_dedup.near_duplicate_groups(df).collect()
    assert len(groups) == 62 and sum(r["n_shingles"] == 0 for r in groups) == 2
    assert near_dedup.one_of_each(df).count() == 62


def test_knapsack_of_many_long_texts_stays_small():
    import tracemalloc

    lengths = np.arange(2, 20_002, 2, dtype=np.int64)
    tracemalloc.start()
    take = mixing.fit_budget(lengths, np.full(len(lengths), 1), 50_000_001)
    assert tracemalloc.get_traced_memory()[1] < 20e6 and int((take * lengths).sum()) == 50_000_000
    tracemalloc.stop()


# --- all --------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (
        quality_classifier.classify(empty, labels), sharding.assign_shards(empty), decontamination.contamination(empty, items),
        lm_scoring.class_scores(empty), license_scan.license_scan(empty), near_dedup.near_duplicate_groups(empty), near_dedup.one_of_each(empty),
        pii.find_pii(empty), quality_rules.host_quality_rules(empty), language_id.identify(empty, language_id.train(empty)),
        mixing.mix_sources(empty), mixing.expand_mix(empty, mixing.mix_sources(empty)), decontamination.clean(empty, items),
    ):
        assert df.count() == 0
    assert decontamination.contamination(empty, items.where("item_id > 5")).count() == 0


def test_contract_columns(spark):
    want = {
        "op2": "doc_id size text_crc32 law shard slot grown_shard", "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op5": "doc_id n_words n_base first_word last_word base_labels labels score", "op6": "doc_id n_shingles component_id kept",
        "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9": "doc_id held_out lang_pred score", "op10": "doc_id size source_size target taken",
        "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12": "lang source part item value rank", "op13": "page_id host path rule verdict",
    }
    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        assert set(want.get(name.split("_")[0], "doc_id").split()) <= set(df.columns), name
    row = queries.QUERIES["op7_contextual_pii"](spark, SF).where("n_email + n_ip > 0").first()
    kinds = [x for x in row["spans"].split(",") if not x.startswith("context")]
    assert row["base_sha256"] == hashlib.sha256(",".join(kinds).encode()).hexdigest()
