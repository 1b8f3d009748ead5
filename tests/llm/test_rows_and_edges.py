"""Odd rows in every operator and stage: nulls, empty and long texts, repeats, clashing names."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rotorwatch.llm import (
    exact_dedup, jaccard, maxent_lm, mixing, packing, quality_qda, quality_rules, queries, secrets, substring_dedup, toxicity,
)

LONG = " ".join(f"w{k % 977}x{k % 1009}" for k in range(60_000))
ROWS = [
    (1, "the same words stand here twice or more", "a"), (2, "the same words stand here twice or more", "a"),
    (2, "the same words stand here twice or more", "a"), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"),
    (None, "a text without an id of its own", "b"), (None, None, None), (6, LONG, "a"), (6, "another text, same id", "a"),
    (7, "naïve façade — 世界 🙂 İstanbul ſ K", "c"), (None, "a text without an id of its own", "b"),
]
SCHEMA = "doc_id long, text string, source string, score string, kept int, position string, ids string, word string, n int, block string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t.parquet")
    spark.createDataFrame([(*r, "s", 1, "p", "i", "w", 2, "k") for r in ROWS], SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def operators(labels):
    every = F.lit(True)

    def qda(docs):
        stats = quality_qda.features(docs)
        return quality_qda.score(stats, quality_qda.fit(stats, labels, every))

    def lm(docs):
        model, counts, ranks = maxent_lm.fit(docs, every)
        return maxent_lm.score(ranks, model, counts)

    return {
        "pack": packing.pack, "scan": secrets.scan, "mix": lambda d: mixing.mix(d, {"a": 3, "b": 2}),
        "clean": quality_rules.clean, "toxic": lambda d: toxicity.score(d, toxicity.fit(d, labels, every)),
        "near": jaccard.near_duplicates, "exact": exact_dedup.exact_groups, "substring": substring_dedup.remove_repeats,
        "lm": lm, "qda": qda,
    }


NAMES = ["pack", "scan", "mix", "clean", "toxic", "near", "exact", "substring", "lm", "qda"]
COLLAPSED = {"near", "exact"}  # rows equal in id and text give one row


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, labels, name):
    out = operators(labels)[name](odd)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows if name != "pack" or r["piece"] == 0]
    expected = [r[0] for r in (dict.fromkeys((i, t or "") for i, t, _ in ROWS) if name in COLLAPSED else ROWS)]
    assert sorted(map(str, ids)) == sorted(map(str, expected))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(odd, labels, name):
    assert operators(labels)[name](odd.where("false")).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_labels_and_texts(odd, labels, name):
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert operators(labels.where("false"))[name](blank).count() >= 1


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for docs in (odd, odd.where("false")):
        out = run(spark, docs, str(tmp_path))
        rows = out.collect()
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and len(rows) <= docs.count()
        if name == "pfair_mix":
            assert len(rows) == docs.count()
        if name == "exact_dedup" and rows:
            texts = [r["text"] or "" for r in rows]
            assert sorted(texts) == sorted({t or "" for _, t, _ in ROWS})


def test_exact_groups_rules(odd):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
    same = [r for r in got.values() if r["group_size"] == 3 and r["keep_id"] == 2]
    assert {(r["doc_id"], r["kept"], r["times"]) for r in same} == {(1, False, 1), (2, True, 2)}
    empty = [r for r in got.values() if r["keep_id"] == 4]
    assert {(r["doc_id"], r["kept"]) for r in empty} == {(3, False), (4, True), (None, False)}


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_ties_of_block_hashes_change_nothing(spark, bits):
    texts = ["", "a", "ab" * 9, "ab" * 8 + "ac", "ab" * 9, "b" + "ab" * 9, "ab" * 40, "ab" * 41, "ab" * 40, "ba" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, block_bytes=4, hash_bits=bits).collect()}
    assert got == {k: max(j for j, t in enumerate(texts) if t == s) for k, s in enumerate(texts)}


@pytest.mark.parametrize("share", [1, 3, 10**6])  # no key is frequent, some are, all are
def test_frequent_keys_change_nothing(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    texts = ["same text of many rows"] * 12 + [f"text {k} ends alike" for k in range(8)] + ["ab" * 20, "ab" * 21, "ab" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, block_bytes=4).collect()}
    assert got == {k: (max(j for j, t in enumerate(texts) if t == s), texts.count(s)) for k, s in enumerate(texts)}


def test_sequences_follow_the_mix(spark, monkeypatch, tmp_path):
    """Shares of the sources along ``sequence_id`` are those of the weights, for other weights too."""
    docs = spark.createDataFrame(
        [(k, f"text {k} " + "word " * (k % 90), "ab"[k % 2]) for k in range(4096)], "doc_id long, text string, source string")
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for a, b in ((3, 1), (1, 3)):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"a": a, "b": b})
        mixed = corpus_pipeline.mix_sources(spark, docs, "").orderBy("source", "doc_id")  # as files read in any order
        rows = sorted(corpus_pipeline.pack_sequences(spark, mixed, "").collect(), key=lambda r: r["sequence_id"])
        assert sorted(r["doc_id"] for r in rows) == list(range(4096))
        order = [source[r["doc_id"]] for r in rows]
        for k in range(0, 2048, 512):  # until the favoured source ends
            assert abs(order[k:k + 512].count("a") / 512 - a / (a + b)) < 0.13
        again = corpus_pipeline.pack_sequences(spark, docs, "").collect()
        key = lambda r: (r["doc_id"], r["piece"], r["sequence_id"], r["offset"])
        assert sorted(map(key, rows)) == sorted(map(key, again))  # from files in any order


def test_gradients_come_from_all_training_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(200)], "doc_id long, text string").repartition(3)
    sums, added = [], maxent_lm._added

    def counting(held):
        def run(batches):
            table = np.zeros((maxent_lm.BLOCK_ROWS, 64), np.float32)
            table[0, 0] = sum(b.num_rows for b in batches)
            if table.any():
                yield maxent_lm._as_batch(list(maxent_lm._blocks([table])))
        return run

    def recorded(parts):
        sums.append(added(parts))
        return sums[-1]

    monkeypatch.setattr(maxent_lm, "_gradient", counting)
    monkeypatch.setattr(maxent_lm, "_added", recorded)
    maxent_lm.fit(docs, F.col("doc_id") % 4 != 0)
    assert sum(s[0][0, 0] for s in sums[1:]) == 150  # the first sum is that of the feature counts
    with pytest.raises(ValueError):
        maxent_lm.fit(docs, F.lit(True), rounds=2, share=8)


def test_repeated_rows_give_a_row_each(spark, tmp_path):
    rows = [(1, "one text of some words here"), (1, "one text of some words here"), (2, "one text of some words here"),
            (3, None), (3, ""), (4, "another"), (4, "another"), (4, "another")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = duck.execute(queries.SQL["op7_exact_dedup"])
    columns = [d[0] for d in cur.description]
    got = queries.op7_exact_dedup(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
    near = queries.op6_ngram_jaccard(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in near) == sorted(k for k, _ in rows)
