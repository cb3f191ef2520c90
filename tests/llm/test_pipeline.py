"""The pipeline, stage by stage and as a whole."""

from __future__ import annotations

import collections

import corpus_pipeline
from terraquill.llm import decontamination, language_id, near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.identify(source, language_id.train(source)).collect() if r["rejected"]}
    ids = {name: [r["doc_id"] for r in x] for name, x in rows.items()}
    assert set(ids["language_id"]) == {r["doc_id"] for r in source.collect()} - rejected
    first = spark.read.parquet(f"{tmp_path}/language_id")
    kept = {r["doc_id"] for r in near_dedup.near_duplicate_groups(first).collect() if r["kept"]}
    assert sorted(ids["near_dedup"]) == sorted(kept)
    second = spark.read.parquet(f"{tmp_path}/near_dedup")
    bad = {r["doc_id"] for r in decontamination.contamination(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(ids["decontamination"]) == set(ids["near_dedup"]) - bad
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(collections.Counter(ids["mixing"]).values()) <= 2
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(whole) == sorted(rows["sharding"])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, kept boolean, slot int, item_id long, _gone int, copies int"


def awkward_tables(spark, folder, n: int) -> list[tuple]:
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and columns named like the operators' own."""
    words = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 900").orderBy("doc_id").limit(40).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rest = (1, 2, "s", True, 3, 4, 5, 6)
    rows = [(k, t, "en", ("a", "b", None)[k % 3], *rest) for k, t in enumerate(words)]
    rows += [(100, None, None, None, *[None] * 8), (101, "", "en", "a", *rest), (102, " \n\t", None, "a", *rest), (103, " ".join(words) * 12, "en", "a", *rest)]
    rows += [rows[3], rows[3], rows[40], (3, words[4] + " more", "en", "b", *rest), (104, words[5], "en", "b", *rest), (105, f"{words[6]} {item} {words[7]}", "en", "a", *rest)]
    rows += [(None, words[8] + " end", "en", "a", *rest), (None, None, "en", None, *rest), (106, "12345 !!", "en", "a", *rest)]
    rows = rows[:n]
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_awkward_documents(spark, tmp_path):
    rows = awkward_tables(spark, tmp_path, 99)
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns
            left[name] = collections.Counter(tuple(r) for r in docs.collect())
            assert set(left[name]) <= set(rows)  # no row is altered
    ids = {name: collections.Counter(r[0] for r in x.elements()) for name, x in left.items()}
    assert not {100, 101, 102, 106} & set(ids["language_id"]) and ids["language_id"][3] == 4  # no letters; repeated rows stay apart
    assert ids["near_dedup"][3] == 1 and 104 not in ids["near_dedup"] and {103, None} <= set(ids["near_dedup"])
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {105}
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(ids["mixing"].values()) <= 2
    placed = docs.collect()
    assert len(placed) == sum(ids["mixing"].values()) and {r["shard"] for r in placed} <= set(range(8))
    for s in range(8):
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty_documents(spark, tmp_path):
    awkward_tables(spark, tmp_path, 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
