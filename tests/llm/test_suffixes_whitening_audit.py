"""Suffix sorting, whitening and the source audit against plain versions, and their odd rows."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorwatch.llm import queries, source_audit, suffix_dedup, whitening

# --- suffixes ---------------------------------------------------------------------------------


def plain_repeats(texts, n):
    """Per text the flags of bytes that go."""
    seen = Counter(t[k:k + n] for t in texts for k in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k:k + n]] > 1:
                gone[k:k + n] = True
        out.append(gone)
    return out


def check_repeats(df, texts, n, **kw):
    flags = dict(zip(texts, plain_repeats([t.encode() for t in texts.values()], n), strict=True))
    rows = suffix_dedup.remove_repeats(df, n, **kw).collect()
    assert len(rows) == len(texts)
    for r in rows:
        gone, data = flags[r["doc_id"]], texts[r["doc_id"]].encode()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
        assert r["removed"] == edges and r["n_spans"] == len(edges)
        assert (r["n_bytes"], r["n_removed"]) == (len(data), gone.sum())
        assert bytes(r["kept"]) == data if not edges else bytes(r["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone])
    return flags


@pytest.mark.parametrize("window", [200, 40, 5])
def test_repeated_bytes(corpus, window):
    texts, docs = corpus
    flags = check_repeats(docs, texts, window)
    assert any(f.any() and not f.all() for f in flags.values())


def crowd(seed=1):
    """One passage in every text, periodic texts, copies, umlauts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgäöü") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randint(0, 60)) + passage + prose(r.randint(0, 60)) for _ in range(150)]
    return [*texts, "a" * 900, "ab" * 300, "xyz" * 70, "é" * 130, "", passage, texts[3], texts[3], passage[:-1] + "!"]


@pytest.mark.parametrize("limit", ["crowded", "lots", "batches"])
def test_limits_change_no_result(spark, monkeypatch, tmp_path, limit):
    texts = dict(enumerate(crowd()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    small = {"crowded": ("CROWD", 3), "lots": ("LOT", 1000), "batches": ("BATCH", 1)}[limit]
    # Workers import modules by themselves, so a changed limit needs a module of its own.
    source = open(suffix_dedup.__file__).read()
    source = re.sub(rf"^{small[0]} = .*$", f"{small[0]} = {small[1]}", source, flags=re.M)
    name = f"suffix_{limit}"
    (tmp_path / f"{name}.py").write_text(source)
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    sys.path.insert(0, str(tmp_path))
    try:
        changed = __import__(name)
        assert getattr(changed, small[0]) == small[1]
        monkeypatch.setattr(suffix_dedup, "remove_repeats", changed.remove_repeats)
        check_repeats(df, texts, 60)
    finally:
        sys.path.remove(str(tmp_path))


@pytest.mark.parametrize("depth", [1, 2, 7, 60])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_suffix_order(depth, letters):
    r = random.Random(depth)
    for n in [*range(0, 12), 100, 500]:
        s = "".join(r.choice(letters) for _ in range(n))
        order = suffix_dedup.suffix_order(np.frombuffer(s.encode(), np.uint8).astype(np.int64), depth)
        assert sorted(order.tolist()) == list(range(n))
        heads = [s[k:k + depth] for k in order]
        assert heads == sorted(heads)


def test_names_beyond_one_word():
    r = np.random.default_rng(1)
    a, b, c = r.integers(0, 1 << 40, (3, 500))
    a[100:200] = a[:100]
    b[100:200] = b[:100]
    names = suffix_dedup._names(a, b, c)
    assert [tuple(x) for x in np.stack([a, b, c], 1)[np.argsort(names)]] == sorted(zip(a, b, c, strict=True))


# --- whitening --------------------------------------------------------------------------------


def vectors(n=400, d=12, seed=3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.2).astype(np.float32)


def plain_whitening(c, k):
    x = np.floor(256 * c.astype(float))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return n, deviation, (x - total / n) @ parts[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening(spark):
    c = np.concatenate([vectors(), vectors()[:50]])
    rows = [(k, v.tolist()) for k, v in enumerate(c)]
    bad = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    n, deviation, white, explained = plain_whitening(c, 4)
    got = defaultdict(dict)
    for r in whitening.whitened_components(df).collect():
        got[r["vec_id"]][r["component"]] = r
    assert len(got) == len(rows) and all(sorted(v) == [1, 2, 3, 4] for v in got.values())
    sign = np.sign([got[0][k + 1]["whitened"] * white[0, k] for k in range(4)])
    for k, v in got.items():
        assert [int(r["deviation"]) for r in v.values()] == [deviation[k]] * 4 and v[1]["n"] == n
        assert np.allclose([v[j + 1]["whitened"] for j in range(4)] * sign, white[k], atol=1e-9)
        assert np.allclose([v[j + 1]["explained"] for j in range(4)], explained, rtol=1e-10)
    assert max(r["identity_error"] for v in got.values() for r in v.values()) < 1e-10


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [2, 2, 1, 1, 0, 0], [0, 0, 0], [7], [1e8, 1, 1e-8], [3, 3 + 1e-9, 3 - 1e-9, 1],
    [1, -1, 2, -2], list(np.linspace(1, 2, 40)), [2.0**-k for k in range(30)],
])
def test_divide_and_conquer(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(len(values),) * 2))
    a = q @ np.diag(values).astype(float) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigen(a)
    scale = max(1e-300, np.abs(values).max())
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-12 * scale)
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ v - v * e).max() <= 1e-11 * scale
    assert np.allclose(whitening.polar(a) @ whitening.polar(a), np.eye(len(values)), atol=1e-10) or min(np.abs(values)) <= 1e-8 * scale


def test_whitening_of_odd_rows(spark):
    schema = "vec_id string, embedding array<double>, x int, n string"
    make = lambda rows: spark.createDataFrame([(*r, 1, "n") for r in rows], schema)
    assert whitening.whitened_components(make([])).count() == 0
    assert whitening.whitened_components(make([("a", None), ("b", [])])).count() == 0
    same = whitening.whitened_components(make([("a", [1.0, 2.0]), (None, [1.0, 2.0]), ("a", [1.0, 2.0])])).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 for r in same)
    flat = whitening.whitened_components(make([("a", [1.0, 2.0, 0.0]), ("b", [3.0, 2.0, 0.0])])).collect()
    assert sorted(r["component"] for r in flat) == [1, 1, 2, 2, 3, 3]
    assert sorted(round(r["whitened"], 9) for r in flat if r["component"] == 1) == [-1, 1]
    huge = whitening.whitened_components(make([("a", [1e18, 0.0]), ("b", [-1e18, 1.0])])).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge)


# --- source audit -----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, most):
    def fold(t):
        return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t)

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, t in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = [fold(x) for x in TERM.findall(t)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: E731,B023
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", terms, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:cut])]
    return out


def audit_rows(seed=2):
    r = random.Random(seed)
    sizes = [1, 3, 8, 9, 15, 16, 17, 32, 33, 70]
    vocabulary = ["".join(r.choice("abcdeZäß世") for _ in range(r.choice(sizes))) for _ in range(160)]
    out = [(r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "ß", None, ""]),
            r.choice([" ", "-", "\n1"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for _ in range(150)]
    return [*out, ("en", "empty", None), ("fr", "alone", "one two"), ("en", "a", "x" * 5000), (None, "q", " @[`{\x7f")]


@pytest.mark.parametrize("least,most", [(3, 50), (1, 4), (1000, 50)])
def test_audit(spark, least, most):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = [tuple(r) for r in source_audit.audit(df, least, most=most).select(
        "lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(plain_audit(rows, least, most))


def test_audit_of_odd_rows(spark):
    schema = "lang string, source string, text string, term string, n int, cells string"
    empty = spark.createDataFrame([], schema)
    assert source_audit.audit(empty).count() == 0
    twice = spark.createDataFrame([("a", "s", "word", "t", 1, "c"), ("a", "s", "word", "t", 1, "c"), ("a", "t", None, "t", 1, "c")], schema)
    assert [tuple(r) for r in source_audit.audit(twice, least=2).orderBy("source").collect()] == [
        ("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_shares_are_exact():
    r = random.Random(3)
    for _ in range(200):
        total = r.randint(1, 1 << 53)
        count = r.randint(0, total)
        assert source_audit.shares(np.array([count]), total)[0] == 1 + 10**9 * count // total


def test_radix_order():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 1 << 63, 3000, np.uint64) % np.uint64(1 << 50), r.integers(0, 3, 3000).astype(np.uint32)
    a[1000:] = a[:2000]
    assert (source_audit.radix_order(b, a) == np.lexsort((b, a))).all()


# --- queries ----------------------------------------------------------------------------------


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in queries.op11_suffix_dedup(spark, sf).collect()}
    for r, gone in zip(docs, plain_repeats([(r["text"] or "").encode() for r in docs], 200), strict=True):
        kept = bytes(np.frombuffer((r["text"] or "").encode(), np.uint8)[~gone])
        assert rows[r["doc_id"]]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert rows[r["doc_id"]]["n_removed"] == gone.sum()
    parts = queries.op12_whitening(spark, sf)
    assert parts.where("deviation IS NULL OR identity_error > 1e-4").count() == 0 < parts.count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op13_source_audit"])
    names = [d[0] for d in want.description]
    got = queries.op13_source_audit(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_odd_documents(spark):
    rows = [(1, None), (None, "text " * 60), (2, ""), (2, "text " * 60), (3, "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "k", "l") for r in rows], "doc_id int, text string, lot int, kept string, ids string")
    out = suffix_dedup.remove_repeats(df)
    assert out.schema["doc_id"].dataType.simpleString() == "int" and out.count() == 5
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(named).collect()}["d3"] == 300_000
