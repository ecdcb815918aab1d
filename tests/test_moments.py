"""Moments against numpy and Spark ML: sums, regularised fits, folds, least squares with factors."""
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelstats.operators import model, moments


def of(x):
    x = np.asarray(x, float).reshape(len(x), -1 if len(x) else 3)
    gap = x - x.mean(0) if len(x) else x
    return moments.Moments(float(len(x)), x.mean(0) if len(x) else np.zeros(x.shape[1]), gap.T @ gap)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-1e6, 1e6)] * 3), min_size=2, max_size=30), st.integers(0, 30))
def test_moments_add_up(rows, cut):
    both = of(rows[:cut] or np.empty((0, 3))) + of(rows[cut:] or np.empty((0, 3)))
    want = of(rows)
    assert both.n == want.n and np.allclose(both.mean, want.mean) and np.allclose(both.scatter, want.scatter, rtol=1e-6, atol=1e-3)


def table(spark, n=400, seed=1, shift=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.2] + shift
    g, h = r.choice(["a", "b", "c"], n), r.choice(["p", "q"], n)
    y = 3 + x @ [2, -0.3, 4] + (g == "b") * 1.5 + (h == "q") * x[:, 0] * 0.7 + r.normal(size=n)
    rows = [(i, *map(float, a), str(b), str(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x, g, h, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, g string, h string, y double"), x, g, h, y


def test_missing_columns_are_part_of_the_group(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (None, 3.0, "a"), (5.0, float("nan"), "a"), (7.0, 9.0, None)], "x double, y double, g string")
    got = moments.by_group(df, {"x": moments.present("x"), "y": moments.present("y")}, {"g": F.col("g")})
    assert {k: m.n for k, m in got.items()} == {("a", (False, False)): 1, ("a", (True, False)): 1, ("a", (False, True)): 1, (None, (False, False)): 1}
    assert got["a", (True, False)].mean.tolist() == [0.0, 3.0]


@pytest.mark.parametrize("enet", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("standardize", [False, True])
@pytest.mark.parametrize("intercept", [False, True])
def test_fit_equals_spark_ml(spark, enet, standardize, intercept):
    df, *_ = table(spark)
    lr = LinearRegression(featuresCol="f", labelCol="y", regParam=0.8, elasticNetParam=enet, standardization=standardize,
                          fitIntercept=intercept, tol=1e-12, maxIter=1000, solver="normal")
    want = lr.fit(VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="f").transform(df))
    (m,) = moments.by_group(df, {c: moments.present(c) for c in ("x1", "x2", "x3", "y")}, {}).values()
    w, b = moments.fit(m, 0.8, enet, standardize, intercept, 1000, 1e-12)
    assert np.allclose(w, want.coefficients.toArray(), atol=1e-5) and abs(b - want.intercept) < 1e-5


def test_large_means_cost_no_digits(spark):
    df, x, g, h, y = table(spark, shift=1e7)
    out = {r["term"]: r for r in model.ols_summary(df, "y", ["x1", "x2", "x3"]).collect()}
    c = x - x.mean(0)
    beta = np.linalg.lstsq(np.column_stack([c, np.ones(len(c))]), y - y.mean(), rcond=None)[0]
    assert np.allclose([out[t]["estimate"] for t in ("x1", "x2", "x3")], beta[:3], rtol=1e-6)


@pytest.mark.parametrize("metric", ["rmse", "mse", "r2", "mae"])
def test_cross_validation_equals_fitting_each_fold(spark, metric):
    df, x, g, h, y = table(spark)
    fold = np.array([r[0] for r in df.orderBy("id").select(model.split_hash("id", 123) % 4).collect()])
    maps = [{"regParam": 0.0}, {"regParam": 0.5, "standardization": True}, {"regParam": 0.5, "elasticNetParam": 1.0, "tol": 0.0}]
    res, best = model.cross_validate(df, ["x1", "x2", "x3"], "y", key="id", grid_maps=maps, folds=4, metric=metric)
    got = [r[f"avg_{metric}"] for r in res.collect()]
    want = []
    for m in maps:
        scores = []
        for f in range(4):
            a, b = fold != f, fold == f
            w, c = moments.fit(of(np.column_stack([x, y])[a]), m["regParam"], m.get("elasticNetParam", 0.0), m.get("standardization", False))
            e = y[b] - x[b] @ w - c
            scores.append({"rmse": np.sqrt((e**2).mean()), "mse": (e**2).mean(), "mae": abs(e).mean(),
                           "r2": 1 - (e**2).sum() / ((y[b] - y[b].mean()) ** 2).sum()}[metric])
        want.append(np.mean(scores))
    assert np.allclose(got, want, rtol=1e-6)
    assert best["regParam"] == maps[int(np.argmax(want) if metric == "r2" else np.argmin(want))]["regParam"] and len(best["coefficients"]) == 3


def test_cross_validation_scans_once(spark, monkeypatch):
    df, *_ = table(spark)
    calls = []
    real = moments.by_group
    monkeypatch.setattr(moments, "by_group", lambda *a: calls.append(1) or real(*a))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model.cross_validate(df, ["x1"], "y", key="id")
    assert calls == [1] and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_cross_validation_skips_missing_rows_and_needs_two_folds(spark):
    df, *_ = table(spark)
    more = df.unionByName(df.limit(5).withColumn("x1", F.lit(None).cast("double")))
    a, b = (model.cross_validate(d, ["x1", "x2"], "y", key="id", grid_maps=[{}])[0].first()[-1] for d in (df, more))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        model.cross_validate(df.limit(0), ["x1"], "y", key="id")


def test_models_with_factors_and_products_from_one_scan(spark):
    df, x, g, h, y = table(spark)
    df = df.withColumn("x2", F.when(F.col("id") % 10 != 0, F.col("x2")))
    whole = np.arange(len(y)) % 10 != 0
    models = {"m1": ["x1", "x2", "g"], "m2": ["x1", "g", "x1:h"], "m3": ["x3", "g:h"], "m4": ["x1:x2"]}
    design = {
        "m1": (whole, {"x1": x[:, 0], "x2": x[:, 1], "g_b": g == "b", "g_c": g == "c"}),
        "m2": (whole | True, {"x1": x[:, 0], "g_b": g == "b", "g_c": g == "c", "x1:h_q": x[:, 0] * (h == "q")}),
        "m4": (whole, {"x1:x2": x[:, 0] * x[:, 1]}),
    }
    rows = model.least_squares_models(df, "y", models).collect()
    for name, (keep, cols) in design.items():
        got = {r["term"]: r for r in rows if r["model"] == name and r["estimate"] is not None}
        X = np.column_stack([*(np.asarray(c, float)[keep] for c in cols.values()), np.ones(keep.sum())])
        beta, sse, *_ = np.linalg.lstsq(X, y[keep], rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * sse[0] / (len(X) - X.shape[1]))
        assert set(got) == {*cols, "(Intercept)"}
        for i, t in enumerate([*cols, "(Intercept)"]):
            assert got[t]["estimate"] == pytest.approx(beta[i], abs=1e-7) and got[t]["std_error"] == pytest.approx(se[i], rel=1e-6)
            assert got[t]["n"] == keep.sum()
    # x1:h_p and x1:h_q add up to x1, so the later one is aliased
    assert [r["term"] for r in rows if r["model"] == "m2" and r["estimate"] is None] == ["x1:h_p"]
    assert sum(r["model"] == "m3" and r["estimate"] is not None for r in rows) == 1 + 5 + 1


def test_p_values_are_those_of_spark_ml(spark):
    df, *_ = table(spark, n=30)
    lr = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="f").transform(df))
    got = model.ols_summary(df, "y", ["x1", "x2", "x3"]).collect()
    assert np.allclose([r["p_value"] for r in got], lr.summary.pValues, rtol=1e-7, atol=1e-15)


def test_t_tail_of_known_cases():
    assert moments.t_tail(0.0, 5) == 1.0
    for t in (0.1, 1.0, 3.0, 40.0):
        assert moments.t_tail(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-9)
        assert moments.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
        assert moments.t_tail(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)
    for t in (0.1, 1.0, 3.0, 6.0):  # the forms for few and many degrees of freedom meet
        assert moments.t_tail(t, 1e6) == pytest.approx(moments.t_tail(t, 1e6 + 1), rel=1e-6)
        assert moments.t_tail(t, 2000) == pytest.approx(moments.t_tail(t, 2001), rel=2e-2)


@pytest.mark.parametrize(("digits", "few"), [(12, 10_000), (4, 1), (3, 20)])
def test_kth_smallest_without_a_sort(spark, monkeypatch, digits, few):
    monkeypatch.setattr(model, "SELECT_DIGITS", digits)
    monkeypatch.setattr(model, "SELECT_FEW", few)
    values = sorted([int(x) for x in np.random.default_rng(3).integers(0, 1 << 20, 300)] + [7] * 40)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(4)
    for k in (1, 20, 45, 340):
        assert model.kth_smallest(df, F.col("v"), k, digits=20) == values[k - 1]
    assert model.kth_smallest(df, F.col("v"), 341, digits=20) is None


@pytest.mark.parametrize("frac", [0.1, 0.37, 0.9])
def test_exact_holdout_counts_and_participants(spark, frac):
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("who"))
    train, test = model.exact_holdout(df, "id", frac)
    assert test.count() == round(1003 * frac) and train.count() + test.count() == 1003
    again = model.exact_holdout(df.repartition(9), "id", frac)[1]
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in test.collect())
    train, test = model.exact_holdout(df, "id", frac, by="who")
    a, b = ({r.who for r in d.collect()} for d in (train, test))
    assert not a & b and len(b) == round(51 * frac) and len(a) + len(b) == 51
    assert [d.count() for d in model.exact_holdout(df.limit(0), "id", frac)] == [0, 0]
