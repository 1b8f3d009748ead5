"""Held-out accuracy of the classifiers, and the queries over the given tables."""

import os
import zlib

import duckdb
import pytest

from rotorwatch.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")


def held_out(spark, name, label, modulus, rest):
    rows = QUERIES[name](spark, LARGER).collect()
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label).collect()}
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def share(pairs, label):
    of = [p for p, y in pairs if y == label]
    return sum(of) / len(of)


def test_toxicity(spark):
    pairs = held_out(spark, "op5_toxicity", "toxic", 5, 0)
    assert share(pairs, 1) > 0.85 and share(pairs, 0) < 0.03


def test_quality(spark):
    pairs = held_out(spark, "op10_quality_qda", "quality", 3, 1)
    assert share(pairs, 1) > 0.98 and share(pairs, 0) < 0.05


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    rows = QUERIES["pipeline"](spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) > 700 and len(corpus_pipeline.STAGES) == 5
    length = {}
    for r in rows:
        length[r["sequence_id"]] = length.get(r["sequence_id"], 0) + r["length"]
    assert max(length.values()) <= 1024
