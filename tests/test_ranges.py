"""Ranks by ranges and quantiles by counts against numpy and pandas."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from folioscope.operators import rank, ranges, sampling, stats
from folioscope.plans import catalogue

QUERIES = ["spearman", "auc", "loo_stability", "zipf_fit", "pct_rank_within_year", "mann_whitney_u"]


def frame(spark, rows):
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")


def columns_of(kind):
    rng = random.Random(7)
    return {
        "continuous": [rng.gauss(0, 1) for _ in range(3000)], "ties": [rng.choice([1, 1, 1, 2, 9]) for _ in range(1000)], "nulls": [rng.choice([None, 1.5, -2.0, rng.random()]) for _ in range(800)],
        "hot": [5.0] * 700 + [rng.random() for _ in range(300)], "one": [4.0] * 50, "none": [None] * 20, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-9, 12) for _ in range(500)],
    }[kind]


KINDS = ["continuous", "ties", "nulls", "hot", "one", "none", "wide"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending", [False, True])
def test_by_value(spark, kind, descending):
    values = columns_of(kind)
    rows = [("ab"[i % 3 == 0] if i % 7 else None, v) for i, v in enumerate(values)]
    for within in ([], ["g"]):
        got = {(r["g"] if within else 0, r["v"]): tuple(r)[-5:] for r in ranges.by_value(frame(spark, rows), "v", within, descending, parts=8).collect()}
        groups = {}
        for g, v in rows:
            groups.setdefault(g if within else 0, []).append(v)
        want = {}
        for g, vs in groups.items():
            ahead, total = 0, sum(v or 0 for v in vs)
            some = 0.0
            for v in sorted(set(vs), key=lambda x: (x is not None, x or 0), reverse=descending):
                n = vs.count(v)
                want[g, v] = (n, ahead, len(vs), some, total)
                ahead, some = ahead + n, some + n * (v or 0)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][:3] == want[k][:3]
            assert got[k][3:] == pytest.approx(want[k][3:], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("few", [0, 20_000])
def test_quantiles(spark, monkeypatch, kind, few):
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "CUTS", 7)
    values = columns_of(kind)
    fractions = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = ranges.quantiles(frame(spark, [("x", v) for v in values]).repartition(3), "v", fractions)
    known = [v for v in values if v is not None]
    if not known:
        assert got == [None] * 7
    else:
        assert got == pytest.approx(list(np.quantile(known, fractions)), rel=1e-12)


def test_quantiles_of_groups(spark):
    rows = [(g, v) for g, kind in (("a", "continuous"), ("b", "ties"), (None, "nulls"), ("n", "none")) for v in columns_of(kind)]
    got = {r["g"]: (r["q"], r["m"]) for r in ranges.grouped_quantiles(frame(spark, rows), "v", {"q": 0.2, "m": 0.5}, ["g"]).collect()}
    want = {g: tuple(np.quantile([v for h, v in rows if h == g and v is not None], [0.2, 0.5])) for g in ("a", "b", None)}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    bins = {r["g"]: r["n"] for r in rank.quantile_bins(frame(spark, rows), "v", 4, "q", ["g"]).where("q = 1").groupBy("g").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert bins["a"] == 750


def test_not_a_number_is_largest(spark):
    d = frame(spark, [("x", 1.0), ("x", 2.0), ("x", math.nan)])
    assert ranges.quantiles(d, "v", [0.0, 0.5])[:2] == [1.0, 2.0] and math.isnan(ranges.quantiles(d, "v", [1.0])[0])
    assert [r["before"] for r in ranges.by_value(d, "v", parts=4).orderBy("before").collect()] == [0, 1, 2]


def test_average_ranks_as_pandas(spark):
    values = columns_of("hot") + columns_of("continuous")
    d = spark.createDataFrame([(i, float(v), float(-v * v)) for i, v in enumerate(values)], "i int, v double, w double")
    got = {r["i"]: (r["v"], r["w"]) for r in stats.ranked(d, "v", "w").collect()}
    want = pd.DataFrame({"v": values, "w": [-v * v for v in values]}).rank()
    assert got == {i: (a, b) for i, (a, b) in enumerate(zip(want["v"], want["w"], strict=True))}


@pytest.mark.parametrize("name", QUERIES)
def test_no_order_over_a_whole_table(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window [" in f" {line.lstrip(' :+-')}"]
    assert any("_range" in line for line in windows)
    assert all(re.search(r"\], \[[^\]]+\], \[[^\]]+\]$", line) for line in windows)  # each has columns that part it


@pytest.mark.parametrize("name", ["quartiles_qcut", "quartile_citation_table", "box_summaries", "calibration_table", "band_diagnostics"])
def test_no_quantile_in_one_buffer(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_a_constant_column_is_one_bin(spark):
    d = spark.createDataFrame([(i, 1.0 if i < 6 else float(i), "a" if i < 6 else "b") for i in range(12)], "id int, v double, g string")
    got = {r["id"]: r["q"] for r in rank.position_bins(d, "v", ["id"], 3, "q", ["g"]).collect()}
    assert [got[i] for i in range(12)] == [1] * 6 + [1, 1, 2, 2, 3, 3]


def test_shares_without_weights_are_equal(spark):
    d = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "k string, w long")
    assert [(r["k"], r["quota"]) for r in sampling.hamilton(d, "w", 8, "k").orderBy("k").collect()] == [("a", 3), ("b", 3), ("c", 2)]
    assert [r["quota"] for r in sampling.hamilton(d, "w", 0, "k").collect()] == [0, 0, 0]


def test_coefficients_as_by_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) * [1, 30] + [0, 500]
    y = 3 + 2 * x[:, 0] - 0.01 * x[:, 1] + rng.normal(size=60)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 2.0)], "a double, b double, y double")
    got = {r["term"]: r for r in stats.ols_inference(d, "y", ["a", "b"]).collect()}
    m = np.column_stack([np.ones(60), x])
    beta = np.linalg.solve(m.T @ m, m.T @ y)
    left = y - m @ beta
    errors = np.sqrt(left @ left / 57 * np.diag(np.linalg.inv(m.T @ m)))
    for i, term in enumerate(("intercept", "a", "b")):
        assert got[term]["coefficient"] == pytest.approx(beta[i]) and got[term]["se"] == pytest.approx(errors[i], rel=1e-6)
        assert got[term]["p"] == pytest.approx(stats.t_tail(beta[i] / errors[i], 57), rel=1e-5, abs=1e-12)
        assert got[term]["n"] == 60 and got[term]["df"] == 57
    assert got["a"]["r2"] == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum())
    assert all(math.isnan(r["t"]) for r in stats.ols_inference(d.limit(3), "y", ["a", "b"]).collect())
    with pytest.raises(ValueError, match="made up"):
        stats.ols_inference(d.withColumn("c", d["a"] * 2), "y", ["a", "c"])


def test_poisson_weights():
    w = stats.poisson_weights(np.random.default_rng(1).integers(-(2**63), 2**63, 4000), 50)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.03)
    assert (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert abs(np.corrcoef(w.T)[np.triu_indices(50, 1)]).max() < 0.09  # rounds are not alike
    assert abs(np.corrcoef(w[:300])[np.triu_indices(300, 1)]).max() < 0.75  # nor rows


def test_bootstrap_of_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(10, 20_000)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(-1, None)], "id long, v double").repartition(3)
    run = lambda d: stats.poisson_bootstrap(d, ["id"], {"x": d["v"]}, F.col("x") / F.col("n"), rounds=400).first()
    r = run(d)
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert r["mean"] == pytest.approx(v.mean(), abs=half / 5) and r["rounds"] == 400
    assert (v.mean() - r["low"], r["high"] - v.mean()) == pytest.approx((half, half), rel=0.15)
    assert run(d.repartition(7, "v"))[:] == pytest.approx(r[:])  # however rows are dealt
    old = stats.bootstrap(d, ["v"], lambda b: b["v"].mean(), rounds=300).first()
    assert (r["low"], r["high"]) == pytest.approx(old[1:], abs=half / 4)
    assert tuple(run(d.where("false"))) == (None, None, None, 0)
