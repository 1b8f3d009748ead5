import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rotorwatch.operators.quantiles import average_ranks, exact_percentiles

WANTED = {"lo": ("x", 0.0), "third": ("x", 1 / 3), "mid": ("x", 0.5), "p95": ("x", 0.95), "hi": ("x", 1.0), "ymid": ("y", 0.5)}


def compare(make, p):
    got = exact_percentiles(make(p), ["k"], WANTED).toPandas().set_index("k").sort_index()
    for name, (c, q) in WANTED.items():
        np.testing.assert_allclose(got[name].astype(float), p.groupby("k")[c].quantile(q).sort_index(), rtol=1e-12, equal_nan=True)


def test_percentiles_equal_pandas(make):
    rng = np.random.default_rng(3)
    n = 900
    p = pd.DataFrame({"k": rng.choice(list("abc"), n, p=[0.9, 0.09, 0.01]), "x": rng.normal(size=n), "y": rng.integers(0, 4, n) * 1.0})
    p.loc[rng.random(n) < 0.1, "x"] = np.nan
    compare(make, p)


def test_null_group_and_extra_aggregates(make):
    from pyspark.sql import functions as F

    p = pd.DataFrame({"k": ["a", "a", "b"], "x": [1.0, 2.0, np.nan], "y": [1.0, 1.0, np.nan]})
    got = exact_percentiles(make(p), ["k"], {"mid": ("x", 0.5)}, extra=[F.count("*").alias("n")])
    assert sorted(tuple(r) for r in got.select("k", "n", "mid").collect()) == [("a", 2, 1.5), ("b", 1, None)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0, 2.5, -3.0, 1e9, 1e-9]), min_size=1, max_size=60))
def test_split_percentiles_with_heavy_ties(make, values):
    compare(make, pd.DataFrame({"k": "a", "x": values, "y": values}))


def test_average_ranks_equal_pandas(make):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"k": rng.choice(list("ab"), 500), "x": rng.integers(0, 40, 500) / 4})
    p.loc[:30, "x"] = np.nan
    got = average_ranks(make(p), ["k"], "x", "r").toPandas().sort_values(["k", "x"])
    want = p.assign(r=p.groupby("k")["x"].rank()).dropna().drop_duplicates(["k", "x"]).sort_values(["k", "x"])
    np.testing.assert_allclose(got["r"].astype(float), want["r"])


def test_null_keys_nan_infinities_and_skew(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(None, v) for v in (4.0, 4.0, 1.0, nan, None)] + [("a", v) for v in (inf, -inf, 2.0)]
    rows += [("b", 7.0)] * 3000 + [("b", float(k)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], {"mid": ("x", 0.5), "hi": ("x", 1.0)}).collect()}
    assert (got[None].mid, got[None].hi) == (4.0, 4.0)
    assert (got["a"].mid, got["a"].hi) == (2.0, inf)
    assert (got["b"].mid, got["b"].hi) == (7.0, 999.0)
    ranks = {(r.k, r.x): r.r for r in average_ranks(df, ["k"], "x", "r").collect()}
    assert ranks[None, 1.0] == 1.0 and ranks[None, 4.0] == 2.5
    assert ranks["a", inf] == 3.0 and ranks["b", 7.0] == 7 + 3002 / 2


@pytest.mark.parametrize("n", [1, 2, 19, 39, 40, 41, 999, 9_999, 10_000, 60_000])
def test_brackets_hold_every_place(spark, n):
    """Groups around the sizes at which brackets narrow, in shuffled order, with and without ties."""
    p = pd.DataFrame({"k": "a", "v": np.random.default_rng(n).permutation(n) * 1.0})
    p["t"] = np.floor(p.v / 7)
    shares = [0.0, 1e-4, 0.1, 1 / 3, 0.5, 0.95, 0.9999, 1.0]
    wanted = {f"{c}{i}": (c, q) for c in "vt" for i, q in enumerate(shares)}
    df = spark.createDataFrame(p).repartition(5)
    got = exact_percentiles(df, ["k"], wanted).first()
    for name, (c, q) in wanted.items():
        assert got[name] == pytest.approx(p[c].quantile(q), rel=1e-12, abs=1e-12)


def test_source_is_read_twice_and_only_groups_are_written(make, monkeypatch):
    from rotorwatch.operators import quantiles

    written, write = [], quantiles.materialize

    def counted(df, name):
        written.append((df.inputFiles(), write(df, name)))
        return written[-1][1]

    monkeypatch.setattr(quantiles, "materialize", counted)
    df = make(pd.DataFrame({"k": ["a", "a", "b"], "x": [1.0, 2.0, 3.0], "y": [1.0, 5.0, 7.0]}))
    got = exact_percentiles(df, ["k"], {"m": ("x", 0.5), "q": ("y", 0.25)}, extra=[F.avg("x").alias("mean")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [t.count() for _, t in written] == [2]
    assert sum("y#" in x and "Relation [k#" in x and "_count" not in x for x in plan.splitlines()) == 1
    assert sorted(tuple(r) for r in got.select("k", "mean", "m", "q").collect()) == [("a", 1.5, 1.5, 2.0), ("b", 3.0, 3.0, 7.0)]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_centred_ranks_over_many_parts(spark, make, parts):
    """Ties that fill several parts, ties inside one, weights, a NULL group."""
    from rotorwatch.operators.quantiles import with_centred_ranks

    rng = np.random.default_rng(parts)
    p = pd.DataFrame({"k": rng.choice(list("aab"), 600), "x": np.where(rng.random(600) < 0.4, 50.0, rng.integers(0, 90, 600)),
                      "w": rng.integers(1, 4, 600), "n": range(600)})
    p.loc[:40, "k"] = None
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_centred_ranks(make(p), ["k"], "x", "w", "r").toPandas().sort_values("n")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    every = p.loc[p.index.repeat(p.w)]
    g = every.assign(k=every.k.fillna("none")).groupby("k")["x"]
    want = pd.DataFrame({"n": every.n, "r": g.rank() - (g.transform("size") + 1) / 2, "v": every.x - g.transform("mean")}).drop_duplicates("n")
    np.testing.assert_allclose(got.r.astype(float), want.sort_values("n").r)
    np.testing.assert_allclose(got.r_value.astype(float), want.sort_values("n").v, atol=1e-12)
