"""Source audit, URL filter and tokenizer alignment on awkward rows, against brute force and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from terraquill.llm import queries, source_audit, token_alignment, url_filter

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, total long, item string"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names and a hot source."""
    rng = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Ünder", "ÉCOLE", "the", "The", "日本", "\u00a0", "x9y"]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 20, 200]))) for _ in range(120)]
    texts += [None, "", " \t\n", "12345 !!", "a" * 60_000, " ".join(rng.choices(words, k=40_000)), "café\u0301 naïve", "x\x00y\x7fz<unk><|endoftext|>", "\u2581odd\u2581", "  two  spaces\n\nline "]
    rows = [(k, t, ("en", "fr", None, "en")[k % 4], ("hot", "s2", None, "hot", "")[k % 5], 1, "t", 2, "i") for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None,) * 8, (900, "lonely words", "de", "s9", 1, "t", 2, "i"), (901, None, "de", "s2", 1, "t", 2, "i")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- source audit -------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs: int, top: int) -> set:
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in (tuple(x or "" for x in r) for r in rows):
        terms = [t.translate(LOWER) for t in find(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found)}
    return out


@pytest.mark.parametrize(("which", "min_docs", "top", "block"), [("real", 30, 50, 300), ("real", 5, 7, 10**6), ("awkward", 12, 50, 40), ("awkward", 10**6, 5, 9), ("awkward", 1, 10, 25)])
def test_audit(request, which, min_docs, top, block, monkeypatch):
    df = request.getfixturevalue(which)
    want = plain_audit([(r["text"], r["lang"], r["source"]) for r in df.collect()], min_docs, top)
    rows = source_audit.divergence(df, min_docs=min_docs, top=top, block=block).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_audit_of_an_empty_table(spark):
    assert source_audit.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_with_equal_hashes():
    words = [b"aa", b"bb", b"cc", b"aa", b"b", b"bb", b"dddd", b"aa", b"cc"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    ends = starts + [len(w) for w in words]
    for digest in (lambda x: 7, lambda x: len(x), lambda x: bytes(x)[0]):
        group, first = source_audit.group_slices(data, starts, ends, digest)
        assert [words[k] for k in first[group]] == words and len(first) == len(set(words)) == len(set(group))


def test_block_differences():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, m = rng.integers(1, 6), rng.integers(0, 9)
        dense = rng.integers(1, 50, (n, m))
        base = rng.integers(1, 50, n)
        held = rng.random((n, m)) < 0.4
        full = np.where(held, dense, base[:, None])
        rows, cols = np.nonzero(held)
        got = source_audit.block_differences(rows, cols, dense[rows, cols], base, m)
        assert (got + got.T == np.abs(full[:, None] - full[None]).sum(2)).all()


# --- tokenizer alignment ------------------------------------------------------------------------------------


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    """Whole texts by the libraries themselves, overlaps by loops over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    folder = token_alignment.FOLDER
    a_tok = Tokenizer.from_file(f"{folder}/{token_alignment.A_FILE}")
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{token_alignment.B_FILE}")
    letter = token_alignment.byte_letters()
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("\u2581", " ").encode()
    found, counts = [], collections.Counter()
    for i, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        parts = [[bytes(letter[c] for c in a_tok.id_to_token(x)) for x in a], [piece(x) for x in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append((i, None))
            continue
        at = [[], []]  # the token of each byte
        ends = [set(), set()]
        for k in (0, 1):
            for n, p in enumerate(parts[k]):
                at[k] += [n] * len(p)
                ends[k].add(len(at[k]))
        links = [(a[x], b[y]) for x, y in sorted(set(zip(*at)))]
        cuts = sorted(ends[0] & ends[1])
        groups = []
        for p, q in zip([0, *cuts], cuts):
            x, y = (sorted(set(t[p:q])) for t in at)
            groups.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
        counts.update(links)
        found.append((i, (len(a), len(b), groups, links)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), sha))
    return out


@pytest.mark.parametrize("which", ["real", "awkward"])
def test_alignment(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    want = collections.Counter(plain_alignment([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert sum(r[1] == 0 for r in want) >= (which == "awkward") * 4
    assert collections.Counter(tuple(r) for r in token_alignment.align_tokens(df).collect()) == want
    # Counts joined instead of sent, many small slices, and a memory that is emptied again and again.
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 5_000)
    monkeypatch.setattr(token_alignment, "CACHED", 50)
    assert collections.Counter(tuple(r) for r in token_alignment.align_tokens(df, sent_pairs=0).collect()) == want


def test_alignment_of_spaces_and_empty_tables(spark):
    texts = ["a", " a", "a ", "  ", " ", "a  b   c", "a\t b", "a \u00a0 b", "a\n\n b", "don't  'll", "x\u2003 y", "\u0085 q", "x\x1c y", "9 9  9", "tab\t\t end  ", "e\u0301 \u0301x", "\U0001f600 \U0001f600\u200d", "<s> </s><0x41>", "A\u2581B C"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in token_alignment.align_tokens(df).collect()) == sorted(plain_alignment(list(enumerate(texts))))
    assert token_alignment.align_tokens(df.limit(0)).count() == token_alignment.align_tokens(df.limit(0), sent_pairs=0).count() == 0


# --- URL filter ---------------------------------------------------------------------------------------------


def plain_scores(pages: list[tuple], seeds: dict) -> dict:
    """(trust, distrust) of each host by dense matrices."""
    edges = collections.Counter((h, x) for h, named in pages for x in named if h and x != h)
    hosts = sorted({*seeds, *(x for e in edges for x in e)})
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        w[at[a], at[b]] = n
    links = w.sum(1) > 0
    w[links] /= w[links].sum(1, keepdims=True)
    allowed, blocked = (np.array([seeds.get(h, (0, 0))[k] for h in hosts], float) for k in (0, 1))
    t, r, d = allowed.copy(), np.ones(len(hosts)), blocked.copy()
    for _ in range(url_filter.ROUNDS):
        a = url_filter.DAMPING
        t, r, d = (1 - a) * allowed + a * w.T @ t, (1 - a) + a * w.T @ r, np.where(links, (1 - a) * blocked + a * w @ d, blocked)
    return {h: (t[k] / r[k], d[k]) for h, k in at.items()}


PLANTED = [
    # Farms link to blocked hosts, clean hosts to trusted ones, and one host is named by both.
    *((k, f"https://Bad{k % 3}.NET/x/{k}?a=1", None) for k in range(9)),
    *((20 + k, f"http://farm{k % 2}.example.com/en/{k}", '<a href="https://bad0.net/1">a</a> <a href="//bad1.net/">b</a> mail me@bad2.net.') for k in range(6)),
    *((40 + k, f"http://hub.example.com/p{k}#x", '<a href="http://farm0.example.com/z">f</a><a href=\'https://farm1.example.com\'>g</a>') for k in range(3)),
    *((50 + k, f"https://good.org/fr/{k}/", '<a href="https://friend.example.com/a">x</a>') for k in range(4)),
    *((60 + k, f"https://friend.example.com/en/{k}", '<a href="https://good.org/fr/">x</a><a href="/own">y</a>' + '<a href="https://farm0.example.com/">z</a>' * (k == 1)) for k in range(3)),
    (70, "https://a.example.net/en/1", "x"), (71, "https://a.example.net/en", None), (72, "https://example.net?q=1/en/", None), (73, "https://x.example.com/de/", ""),
    (74, "https://xexample.com/de/", "no host here @user //x"), (75, None, "https://bad0.net/"), (76, "no scheme at all", "https://bad0.net/"), (77, "", ""), (78, "https://", ""),
    (79, "ftp://b.org/fr/http://bad0.net/", None), (79, "ftp://b.org/fr/http://bad0.net/", None), (None, "https://lone.example.org/de/9", "y"), (80, "https://net/", "y"), (81, "https://solo.example.com/" + "x" * 30_000, "z" * 90_000),
]


def test_url_filter(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "h", "v", "r", 1.0) for r in PLANTED], "page_id long, url string, html string, host string, verdict string, rule string, trust double").repartition(3)
    rows = url_filter.filter_urls(df).collect()
    assert len(rows) == len(PLANTED)
    got, named, verdicts = {}, [], collections.defaultdict(list)
    for page, url, html in PLANTED:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        rest = re.split("[?#]", rest)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(LOWER), slash + path
        fits = [(len(r), r, v) for v, r in url_filter.RULES for h in [r.split("/")[0]] if (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fits, default=(0, None, None))
        got[page, host, path, rule[1]] = rule[2]
        verdicts[host].append(rule[2])
        found = re.findall(r"(?:://|[\"'=\s]//|@)([^/?#\"'<>\s@&;,()]+)", html or "")
        named.append((host, {x.lower().rstrip(".") for x in found if "." in x.rstrip(".")}))
    seeds = {h: tuple(v.count(x) / len(v) for x in ("allow", "block")) for h, v in verdicts.items() if h}
    scores = plain_scores(named, seeds)
    for r in rows:
        rule = got[r["page_id"], r["host"], r["path"], r["rule"]]
        trust, distrust = scores.get(r["host"], (0, 0))
        assert abs(r["trust"] - trust) < 2e-6 and abs(r["distrust"] - distrust) < 2e-6
        assert r["verdict"] == (rule or ("block" if distrust >= 0.5 and distrust > trust else "allow"))
    by_host = {r["host"]: r["verdict"] for r in rows if r["rule"] is None}
    assert by_host["farm0.example.com"] == by_host["hub.example.com"] == "block"
    assert by_host["friend.example.com"] == by_host["solo.example.com"] == by_host[""] == by_host["xexample.com"] == "allow"
    # Joined by shuffles, the same.
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)
    assert sorted(map(str, url_filter.filter_urls(df).collect())) == sorted(map(str, rows))


def test_urls_of_an_empty_table(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*columns).collect()) == collections.Counter(want.fetchall())
