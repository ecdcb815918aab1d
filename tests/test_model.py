import numpy as np
import pytest

from panelstats.operators import model


def _data(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    g = rng.choice(["a", "b", "c"], size=n)
    y = 1.5 + 2.0 * x1 - 0.5 * x2 + (g == "b") * 0.7 + rng.normal(scale=0.3, size=n)
    rows = [(float(a), float(b), str(c), float(d), i) for i, (a, b, c, d) in enumerate(zip(x1, x2, g, y))]
    return spark.createDataFrame(rows, "x1 double, x2 double, g string, y double, id long"), x1, x2, g, y


def test_params_validation():
    model.RegressionParams(fracTest=0.1)
    for bad in (0.05, 1.0):
        with pytest.raises(ValueError):
            model.RegressionParams(fracTest=bad)


def test_fit_matches_closed_form(spark):
    df, x1, x2, g, y = _data(spark)
    fitted = model.fit_linear(df, ["x1", "x2"], "y", model.RegressionParams(solver="normal"))
    got = {r["term"]: r["estimate"] for r in model.coefficients(fitted, ["x1", "x2"]).collect()}
    X = np.column_stack([x1, x2, np.ones_like(x1)])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose([got["x1"], got["x2"], got["(Intercept)"]], beta, atol=1e-8)


def test_fit_intercept_is_honoured(spark):
    df, *_ = _data(spark)
    fitted = model.fit_linear(df, ["x1"], "y", model.RegressionParams(fitIntercept=False, solver="normal"))
    assert fitted.stages[-1].intercept == 0.0


def test_holdout_split_is_stable_and_disjoint(spark):
    df, *_ = _data(spark, n=1000)
    train, test = model.holdout_split(df, "id", 0.5)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not (a & b) and len(a | b) == 1000 and 400 < len(b) < 600
    train2, _ = model.holdout_split(df.repartition(7), "id", 0.5)
    assert {r.id for r in train2.collect()} == a


def test_metrics_one_pass(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, prediction double")
    r = model.regression_metrics(df, "y").first()
    assert r["n"] == 3 and abs(r["mse"] - (0.25 + 0 + 1) / 3) < 1e-12
    assert abs(r["mae"] - 0.5) < 1e-12 and abs(r["r2"] - (1 - 1.25 / 2.0)) < 1e-12


def test_ols_summary_standard_errors(spark):
    df, x1, x2, g, y = _data(spark)
    s = model.ols_summary(df, "y", ["x1", "x2", "g"])
    got = {r["term"]: r for r in s.collect()}
    # R: reference level is the alphabetically first ("a"); dummies for b and c.
    X = np.column_stack([x1, x2, (g == "b"), (g == "c"), np.ones_like(x1)]).astype(float)
    beta, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    sigma2 = res[0] / (len(y) - X.shape[1])
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    assert abs(got["g_b"]["estimate"] - beta[2]) < 1e-8
    assert abs(got["x1"]["std_error"] - se[0]) < 1e-8
    assert abs(got["(Intercept)"]["std_error"] - se[4]) < 1e-8
    assert set(got) == {"x1", "x2", "g_b", "g_c", "(Intercept)"}


def test_interaction_models_product_without_main_effect(spark):
    df, x1, x2, g, y = _data(spark)
    out = model.interaction_models(df, "y", ["x1"], "x2", ["g", "x1"])
    terms = {(r["model"], r["term"]) for r in out.collect()}
    assert ("g", "x2:g_a") in terms and ("g", "x2:g_b") in terms and ("g", "x2:g_c") in terms
    assert ("x1", "x2:x1") in terms


def test_cross_validation_grid(spark):
    df, *_ = _data(spark)
    params = model.RegressionParams(maxIter=10)
    lr = model.linear_regression("y", params)
    maps = model.param_grid(lr, params, reg=(0.1,), iters=(), enet=(1.0,), tols=())
    assert len(maps) == 8
    res, best = model.cross_validate(df, ["x1", "x2"], "y", key="id", grid_maps=maps, params=params)
    rows = res.collect()
    assert len(rows) == 8 and min(r["avg_rmse"] for r in rows) < 0.5
    assert "regParam" in best
    assert model.explain_params(lr).count() > 5
