"""Ordered scans and quantiles against plain Python, with a hot group and small slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.plans import slices as S
from convlake.plans.quantiles import exact_quantiles


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out, pos = [], {}
    for _ in range(n):
        k = "hot" if rng.random() < 0.5 else rng.choice([None, "k0", "k1", "k2", "k3"])
        pos[k] = pos.get(k, 0) + rng.randrange(1, 4)
        out.append((k, pos[k], rng.choice([None, 1, 2, 3]), rng.randrange(-5, 6)))
    return out


@pytest.mark.parametrize("levels, span", [(0, 4096), (1, 4096), (1, 3), (3, 2)])
def test_scan_equals_python(spark, monkeypatch, levels, span):
    monkeypatch.setattr(S, "PLAIN_BYTES", 0)
    monkeypatch.setattr(S, "SPAN_LEVELS", levels)
    monkeypatch.setattr(S, "SLICES_PER_SPAN", span)
    data = rows()
    df = spark.createDataFrame(data, "k string, p long, a int, b int")
    specs = [
        S.Lag("lag", F.col("a")), S.Lag("lag_d", F.col("b"), F.lit(99)), S.Lead("lead", F.col("b")), S.RunSum("rs", F.col("b")),
        S.RunSum("rsx", F.col("b"), inclusive=False), S.RunMax("rm", F.col("b"), inclusive=False), S.LastValid("lv", F.col("a")),
        S.LastValid("lvx", F.col("a"), inclusive=False), S.NextValid("nv", F.col("a")), S.NextValid("nvx", F.col("a"), inclusive=False),
        S.AheadMax("am", F.col("a")), S.AheadMax("amx", F.col("b"), inclusive=False),
    ]
    got = {(r.k, r.p): r for r in S.scan(df, ["k"], ["p"], S.by_index("p", 7), specs).collect()}
    groups = {}
    for r in sorted(data, key=lambda x: x[1]):
        groups.setdefault(r[0], []).append(r)
    assert len(got) == len(data)
    for k, g in groups.items():
        a, b = [r[2] for r in g], [r[3] for r in g]
        last = lambda xs: next((x for x in reversed(xs) if x is not None), None)
        first = lambda xs: next((x for x in xs if x is not None), None)
        for i, r in enumerate(g):
            o = got[(k, r[1])]
            assert o.lag == (a[i - 1] if i else None) and o.lag_d == (b[i - 1] if i else 99)
            assert o.lead == (b[i + 1] if i + 1 < len(g) else None)
            assert o.rs == sum(b[: i + 1]) and o.rsx == sum(b[:i])
            assert o.rm == (max(b[:i]) if i else None)
            assert o.lv == last(a[: i + 1]) and o.lvx == last(a[:i])
            assert o.nv == first(a[i:]) and o.nvx == first(a[i + 1 :])
            assert o.am == max((x for x in a[i:] if x is not None), default=None) and o.amx == max(b[i + 1 :], default=None)


def test_a_key_of_a_million_slices(spark, monkeypatch):
    """One row a slice: windows range over a span of slices or over the spans, never over all slices of the key."""
    monkeypatch.setattr(S, "PLAIN_BYTES", 0)
    n = 1 << 20
    df = spark.range(0, n, 1, 8).select(F.lit("x").alias("k"), F.col("id").alias("p"), F.lit(1).alias("v"))
    out = S.scan(df, ["k"], ["p"], S.by_index("p", 1), [S.RunSum("s", F.col("v")), S.LastValid("l", F.when(F.col("p") % 100_000 == 7, F.col("p")))])
    row = out.agg(F.count_if(F.col("s") == F.col("p") + 1).alias("n"), F.max("l").alias("l"), F.count("l").alias("c")).first()
    assert (row.n, row.l, row.c) == (n, 1_000_007, n - 7)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Window [" in x and "_border" in x and "[k#" in x and "_slice#" not in x.split("], [")[1]] == []


def test_join_pieces(spark):
    rows = [("a", i, None if i % 5 == 0 else f"w{i}") for i in range(40)] + [("n", 3, None), (None, 7, "x"), (None, 1, "y"), ("e", 2, ""), ("e", 90, "")]
    df = spark.createDataFrame(rows, "k string, p long, t string").withColumn(S.SLICE, S.by_index("p", 4)).repartition(5)
    got = {r.k: (r.p, r.t, r.text, r.pieces) for r in S.join_pieces(df, ["k"], ["p"], F.col("t"), " ", first=["p"], last=["t"]).collect()}
    words = [t for k, _, t in rows if k == "a" and t is not None]
    assert got == {"a": (0, "w39", " ".join(words), 32), "n": (3, None, "", 0), None: (1, "x", "y x", 2), "e": (2, "", " ", 2)}


def test_neighbours_equal_scan(spark):
    df = spark.createDataFrame([("x", i, i * i) for i in range(50)] + [("y", 0, 7)], "k string, i long, v long")
    n = S.neighbours(df, ["k"], "i", [S.Lag("a", F.col("v"), F.lit(-1)), S.Lead("b", F.col("v"))], rows=8)
    got = {(r.k, r.i): (r.a, r.b) for r in n.collect()}
    assert len(got) == 51 and got[("y", 0)] == (-1, None)
    for i in range(50):
        assert got[("x", i)] == ((i - 1) ** 2 if i else -1, (i + 1) ** 2 if i < 49 else None)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0, 9.0], [300, 5, 7]), "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None)], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q50": 0.5, "q90": 0.9, "q95": 0.95}).collect()}
    for k, v in data.items():
        for name, q in (("q50", 50), ("q90", 90), ("q95", 95)):
            assert abs(got[k][name] - np.percentile(v, q)) < 1e-9
    assert abs(exact_quantiles(df, [], "v", {"m": 0.5}).first().m - np.median(np.concatenate(list(data.values())))) < 1e-9


def test_quantiles_of_null_keys_and_empty_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", None), ("b", 5.0)], "k string, v double")
    got = {r.k: (r.m, r.n) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}, {"n": F.count("v")}).collect()}
    assert got == {None: (1.5, 2), "a": (None, 0), "b": (5.0, 1)}
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_of_many_distinct_and_of_one_heavy_value(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).cast("double").alias("v"), F.lit("x").alias("k"))
    df = df.union(spark.range(15000).select(F.lit(123.0), F.lit("x")))
    values = [r.v for r in df.collect()]
    row = exact_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.999}).first()
    assert np.allclose([row.a, row.b, row.c], np.percentile(values, [1, 50, 99.9]))


def test_scan_shuffles_the_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"), F.col("id").alias("v"))
    out = S.scan(df, ["k"], ["p"], S.by_index("p", 64), [S.RunSum("s", F.col("v")), S.Lead("n", F.col("v"))])
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line and "_slice" in line]
    assert "Join" not in plan and 1 <= len(rows) <= 2  # the union of rows and borders, and the borders' sums
    assert out.agg(F.sum("s")).first()[0] == sum(sum(range(k, i + 1, 3)) for k in range(3) for i in range(k, 1000, 3))


@pytest.mark.parametrize("most", [3, 50])
def test_quantile_ranges_are_cut_again(spark, monkeypatch, most):
    """Ranges above the bound get sketches of their own; a value that fills a range ends it."""
    from convlake.plans import quantiles

    monkeypatch.setattr(quantiles, "WINDOW_ROWS", most)
    monkeypatch.setattr(quantiles, "RANGES", 4)
    rng = np.random.default_rng(most)
    data = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 5.0], [400, 300, 1]), None: np.arange(700.0), "d": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, vs in data.items() for x in vs], "k string, v double").repartition(7)
    qs = {"lo": 0.001, "m": 0.5, "hi": 0.97, "top": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs, {"n": F.count("v")}).collect()}
    for k, vs in data.items():
        assert got[k].n == len(vs) and np.allclose([got[k][n] for n in qs], [np.quantile(vs, q) for q in qs.values()])
