"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. Seed entities come from the base rules (e-mail addresses, IPv4 addresses, card numbers, phone numbers) and from ``SECRET``, the
   plain form of a key: 32 to 64 lower-case hexadecimal digits, letters and figures among them. A secret seed is evidence only: it is
   no span unless an accepted pattern holds it.
2. Candidates are white-space tokens with a digit or @, or up to six numeric tokens with single spaces between them. Of
   ``key=value``, the key is context and the value the instance. The lexical patterns of a candidate, digits folded and A-Z lowered: the two words before
   it; the word before it with its shape (runs of digits, of letters, and of 16 or more of both); the words on both
   sides. Context words may be candidates themselves; a candidate at the start of a text has no pattern.
3. The bipartite graph of patterns and distinct instances is scored in rounds. An instance's confidence is 1 for seeds, else
   the best score of its accepted patterns. A pattern's score is the confidence of its instances over their number plus one, so that
   few instances count less; it is accepted from ``MIN_SCORE`` on, with ``MIN_SUPPORT`` known instances or more.
4. Candidates of accepted patterns that don't touch a base span are added as spans of kind ``context``.

Regular expressions are anchored at the starts of runs, or stop at the first place where the rule ends, so that a very long run is
read once; their matches are those of the plain rules.

Defined cases: a null text is empty and has no spans. Repeated rows each give the same row; their
instances count once, since graph nodes are distinct. An empty table gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm.common import Scratch, bounded_broadcast, lower_ascii

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 5
MIN_SCORE = 0.8
#: The plain form of a secret, as a seed.
SECRET = "^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}$"
ROUNDS = 3
#: Patterns that are broadcast; more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000

_WORD = r"[^\x20\x09-\x0D]"
#: A token of digits and signs of numbers.
_NUMERIC = rf"[().+-]*+[0-9][0-9().+-]*+(?!{_WORD})"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: By kind: what a text must hold for the rule to be tried, and the rule.
RULES = {
    # local@label(.label)+ ; the domain ends before the first "..", or before its end or a last dot.
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_LABEL}+\.{_LABEL})[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))"),
    "ip": ("", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # [0-9]([ -]?[0-9])+ : up to the first digit that no [ -]?[0-9] follows.
    "card": ("", r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "cand": (
        "",
        rf"(?<!{_WORD})(?:{_NUMERIC}(?:\x20{_NUMERIC}){{1,5}}|[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+)",
    ),
}
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_GAP = r"[\x20\x09-\x0D]"
_FIRST, _FIRST_TWO = rf"^{_GAP}*+{_WORD}++", rf"^{_GAP}*+{_WORD}++(?:{_GAP}++{_WORD}++)?"
_STEP = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    number = F.split(F.reverse(digits), "")
    total = F.aggregate(
        number,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("twice")),
        lambda a, d: F.struct(
            (
                a["sum"]
                + F.when(a["twice"] == 0, d.cast("int"))
                .when(d.cast("int") > 4, d.cast("int") * 2 - 9)
                .otherwise(d.cast("int") * 2)
            ).alias("sum"),
            (1 - a["twice"]).alias("twice"),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, text: Column) -> Column:
    """The checks that follow a rule's match."""
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    n = F.length(_digits(text))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(text))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda span: valid(kind, span["text"])


def _matched(text: Column, kind: str) -> list[Column]:
    """Matches of a rule and the lengths of the gaps before them; both empty where the rule can't match."""
    sign, rule = RULES[kind]
    may = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9@]" if kind == "cand" else "[0-9]")
    none = F.array().cast("array<string>")
    gaps = F.when(may, F.split(text, rule, -1)).otherwise(none)
    out = [
        F.when(may, F.regexp_extract_all(text, F.lit(rule), F.lit(0))).otherwise(none).alias(f"{kind}_text"),
        F.transform(gaps, F.length).alias(f"{kind}_gap"),
    ]
    if kind == "cand":
        out += [
            F.transform(gaps, lambda g: F.reverse(F.regexp_extract(F.reverse(g), _FIRST_TWO, 0))).alias("cand_tail"),
            F.transform(gaps, lambda g: F.regexp_extract(g, _FIRST, 0)).alias("cand_head"),
        ]
    return out


def _split(*parts: Column) -> Column:
    return F.array_remove(F.split(F.concat_ws(" ", *parts), rf"{_GAP}+"), "")


def _contexts() -> Column:
    """The two words before each candidate and the one after. A gap ends at candidates, so two words reach back over two of them at most."""

    def read(token: Column, i: Column) -> Column:
        before = _split(F.get("cand_text", i - 2), F.get("cand_tail", i - 1), F.get("cand_text", i - 1), F.get("cand_tail", i))
        after = _split(F.get("cand_head", i + 1), F.get("cand_text", i + 1))
        return F.struct(F.reverse(F.slice(F.reverse(before), 1, 2)).alias("before"), F.get(after, F.lit(0)).alias("after"))

    return F.transform("cand_text", read).alias("cand_context")


def _with_starts(df: DataFrame, kind: str) -> DataFrame:
    """Adds the column of the kind: spans with start, end (code points), text. Lengths are summed in steps, so that the
    work stays nearly linear in the number of matches."""
    gap, text, lens, steps = (f"{kind}_{x}" for x in ("gap", "text", "len", "step"))
    return df.withColumn(
        kind,
        F.expr(
            f"""if(size({text}) > 0,
                transform(sequence(0, size({text}) - 1), i -> named_struct(
                    'start', {steps}[i div {_STEP}] + aggregate(slice({lens}, (i div {_STEP}) * {_STEP} + 1, i % {_STEP}), 0, (a, x) -> a + x) + {gap}[i],
                    'end', {steps}[i div {_STEP}] + aggregate(slice({lens}, (i div {_STEP}) * {_STEP} + 1, i % {_STEP}), 0, (a, x) -> a + x) + {gap}[i] + length({text}[i]),
                    'text', {text}[i])),
                array())"""
        ),
    )


def _steps(kind: str) -> list[Column]:
    """Lengths of gap and match, and their sums before every ``_STEP``-th."""
    gap, text = F.col(f"{kind}_gap"), F.col(f"{kind}_text")
    lens = F.transform(F.arrays_zip(F.slice(gap, F.lit(1), F.size(text)).alias("g"), text.alias("t")), lambda x: x["g"] + F.length(x["t"]))
    return [lens.alias(f"{kind}_len")]


def _sums(kind: str) -> Column:
    lens = f"{kind}_len"
    return F.expr(
        f"""if(size({lens}) > 0, aggregate(sequence(0, (size({lens}) - 1) div {_STEP}), array(0), (a, k) ->
            array_append(a, element_at(a, -1) + aggregate(slice({lens}, k * {_STEP} + 1, {_STEP}), 0, (b, x) -> b + x))), array(0))"""
    ).alias(f"{kind}_step")


def spotted(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, one array of valid spans for each kind, cand: candidates with the words around them)."""
    kinds = (*KINDS, "cand")
    text = F.coalesce(F.col("text"), F.lit(""))
    # Written tables between the steps, so that no array is computed anew inside a lambda.
    found = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
            "doc_id", F.xxhash64("text").alias("text_key"), *(c for k in kinds for c in _matched(text, k))
        ),
        "found",
    )
    lengths = scratch.save(found.select("*", _contexts(), *(c for k in kinds for c in _steps(k))), "lengths")
    summed = scratch.save(lengths.select("*", *(_sums(k) for k in kinds)), "summed")
    for k in kinds:
        summed = _with_starts(summed, k)
    checked = [F.filter(k, _valid_span(k)).alias(k) for k in KINDS]
    left = F.zip_with("cand", "cand_context", lambda s, c: s.withField("before", c["before"]).withField("after", c["after"]))
    out = scratch.save(summed.select("doc_id", "text_key", *checked, left.alias("cand")), "spotted")
    for name in ("found", "lengths", "summed"):
        scratch.drop(name)
    return out


def _folded(words: Column) -> Column:
    return F.regexp_replace(lower_ascii(words), "[0-9]+", "9")


def _shape(instance: Column) -> Column:
    mixed = F.regexp_replace(instance, "(?<![0-9A-Za-z])(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z]{16,}", "~")
    return F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "9"), "[A-Za-z]+", "a")


def candidates(spans: DataFrame) -> DataFrame:
    """Candidates: doc_id, text_key, start, end, instance, patterns, based (it touches a base span), seed."""
    bases = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    rows = spans.where(F.size("cand") > 0).select("doc_id", "text_key", bases.alias("bases"), F.explode("cand").alias("c"))
    token = F.col("c.text")
    key = F.regexp_extract(token, r"^([^=0-9@]*+=)[^0-9@]*+[0-9@]", 1)
    rows = (
        rows.withColumn("key", key)
        .withColumn("value", F.substring(token, F.length("key") + 1, F.length(token)))
        .withColumn("head", F.length("key") + F.length(F.regexp_extract("value", r"^[^A-Za-z0-9+]*", 0)))
        .withColumn("instance", F.regexp_replace(F.regexp_replace("value", r"^[^A-Za-z0-9+]+", ""), r"[^A-Za-z0-9]+$", ""))
        .withColumn("before", F.concat("c.before", F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.array("key"))))
        .where("length(instance) > 3 and instance rlike '[0-9@]' and size(before) > 0")
        .withColumn("start", F.col("c.start") + F.col("head"))
        .withColumn("end", F.col("c.start") + F.col("head") + F.length("instance"))
        .withColumn("last", _folded(F.try_element_at("before", F.lit(-1))))
        .withColumn("two", _folded(F.array_join(F.reverse(F.slice(F.reverse("before"), 1, 2)), " ")))
        .withColumn("based", F.exists("bases", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
    )
    tagged = lambda kind, *parts: F.concat_ws(" ", F.lit(kind), *parts)
    return rows.select(
        "doc_id", "text_key", "start", "end", "instance",
        F.array(
            tagged("words", F.col("two")),
            tagged("shape", F.col("last"), _shape(F.col("instance"))),
            tagged("around", F.col("last"), F.lit("_"), _folded(F.coalesce("c.after", F.lit("")))),
        ).alias("patterns"),
        "based",
        (F.col("based") | F.col("instance").rlike(SECRET)).alias("seed"),
    )


def accepted_patterns(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) after the rounds of scoring."""
    graph = scratch.save(
        tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed")
        .groupBy("pattern", "instance").agg(F.max("seed").cast("double").alias("seed")),
        "graph",
    )
    known = graph.groupBy("instance").agg(F.max("seed").alias("confidence")).where("confidence > 0")
    known = scratch.save(known, "known0")
    for k in range(ROUNDS):
        scored = graph.join(known, "instance", "left").groupBy("pattern").agg(
            (F.sum(F.coalesce("confidence", F.lit(0.0))) / (F.count("*") + 1)).alias("score"), F.count("confidence").alias("support")
        )
        patterns = scratch.save(scored.where((F.col("score") >= MIN_SCORE) & (F.col("support") >= MIN_SUPPORT)).select("pattern", "score"), f"patterns{k}")
        if k + 1 < ROUNDS:
            learned = graph.join(bounded_broadcast(patterns, BROADCAST_PATTERNS), "pattern").select("instance", F.col("score").alias("confidence"))
            known = scratch.save(
                known.union(learned).groupBy("instance").agg(F.max("confidence").alias("confidence")), f"known{k + 1}"
            )
    return patterns


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_spans, context_spans (arrays of kind:start:end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    spans = spotted(docs, scratch, id_col, text_col)
    tokens = candidates(spans)
    patterns = bounded_broadcast(accepted_patterns(tokens, scratch), BROADCAST_PATTERNS)
    added = (
        tokens.where("not based")
        .select("doc_id", "text_key", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern")
        .groupBy(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context"))
    )
    named = lambda kind, c: F.transform(c, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key"))
    return spans.join(added, same, "left").select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.concat(*(named(k, F.col(k)) for k in KINDS)).alias("base_spans"),
        F.coalesce(named("context", F.col("context")), F.array().cast("array<string>")).alias("context_spans"),
    )
