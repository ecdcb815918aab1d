"""Regression operators.

The pipeline fit is Spark ML's (the normal-equation solver aggregates X'X in one
pass; L-BFGS aggregates gradients per iteration).  Cross-validation and the
models with inference work on additive moments from one scan
(:mod:`.moments`); only k x k matrices and coefficients live on the driver.
Results come back as small DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import moments


@dataclass(frozen=True)
class RegressionParams:
    """Model and split parameters, checked on construction (M9)."""

    elasticNetParam: float = 0.0
    fitIntercept: bool = True
    maxIter: int = 100
    regParam: float = 0.0
    standardParam: bool = False
    tol: float = 1e-6
    fracTest: float = 0.5
    seed: int = 123
    solver: str = "auto"

    def __post_init__(self):
        if not (0.1 <= self.fracTest < 1):
            raise ValueError(f"fracTest must be in [0.1, 1), got {self.fracTest}")
        if not (0.0 <= self.elasticNetParam <= 1.0):
            raise ValueError("elasticNetParam must be in [0, 1]")
        if self.maxIter < 0 or self.regParam < 0 or self.tol < 0:
            raise ValueError("maxIter, regParam and tol must be >= 0")


# -- split -------------------------------------------------------------------

def split_hash(key: Column | str, seed: int = 123) -> Column:
    """The first 32 bits of the md5 of ``key:seed``.

    Unlike ``randomSplit`` the assignment depends only on the key, not on the
    partitioning, so a rerun after a lost executor gives the same split.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def first_hash_of_test(frac_test: float) -> int:
    """Rows whose ``split_hash`` is at least this are held out."""
    return round((1 - frac_test) * 2 ** 32)


def holdout_split(df: DataFrame, key: Column | str, frac_test: float = 0.5,
                  seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash; ``frac_test`` in [0.1, 1) (M4, M9)."""
    RegressionParams(fracTest=frac_test)
    cut = first_hash_of_test(frac_test)
    h = split_hash(key, seed)
    return df.where(h < cut), df.where(h >= cut)


#: Binary digits of the hash that one histogram tells apart, and the rows that are few enough
#: to come to the driver as single hashes.
SELECT_DIGITS, SELECT_FEW = 12, 10_000
LONG_DIGITS = 60


def _long_hash(key: Column | str, seed: int) -> Column:
    """The first 60 bits of the md5 of ``key:seed``; :func:`split_hash` is its first 32."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, LONG_DIGITS // 4), 16, 10).cast("bigint")


def kth_smallest(df: DataFrame, value: Column, k: int, digits: int = LONG_DIGITS) -> int | None:
    """The ``k``-th smallest (from 1) of whole numbers below 2^``digits``, without a sort.

    A histogram of the leading digits tells which bin holds it, then a histogram within that
    bin, and so on until so few values are left that they are looked at singly.  Each step
    is one scan that brings at most 2^``SELECT_DIGITS`` counts to the driver; nothing is
    shuffled but partial counts.  ``None`` if there are fewer than ``k`` values.
    """
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    low, shift = 0, digits
    while True:
        width = min(SELECT_DIGITS, shift)
        shift -= width
        bins = rows.groupBy(F.shiftright("v", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(bins, key=lambda r: r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        else:
            return None
        low = r["bin"] << shift
        if not shift:
            return low
        rows = rows.where((F.col("v") >= low) & (F.col("v") < low + (1 << shift)))
        if r["n"] <= SELECT_FEW:
            return sorted(x["v"] for x in rows.collect())[k - 1]


def exact_holdout(df: DataFrame, key: Column | str, frac_test: float = 0.5, seed: int = 123,
                  by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly round(n x ``frac_test``) test units (M4, M9).

    A unit is a row, ordered by the hash of its ``key``, or with ``by`` a participant: then
    all rows of a participant are on one side, and n counts the participants.  The units
    with the largest hashes are held out; the border is found by :func:`kth_smallest`.  The
    split depends on the keys alone, not on the partitioning.  Rows with equal keys share a
    hash and go to one side, so the count is exact where keys are unique; a null key counts
    as the empty text, a row without participant belongs to a participant of its own name "".
    """
    RegressionParams(fracTest=frac_test)
    h = _long_hash(by if by is not None else key, seed)
    units = df.select(_quoted(by).alias("u")).distinct() if by is not None else df
    of_unit = _long_hash("u", seed) if by is not None else h
    n = units.count()
    train = n - round(n * frac_test)
    if train <= 0:
        return df.where(F.lit(False)), df
    cut = kth_smallest(units, of_unit, train)
    return df.where(h <= cut), df.where(h > cut)


# -- fit, predict, evaluate ---------------------------------------------------

def fit_input(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns a multi-pass fit reads, persisted once.

    Fitting passes over the data several times (statistics, normal equations
    or one gradient per iteration, summary), so the projection is cached
    instead of re-reading and re-deriving the source each pass.  The caller
    unpersists it after fitting.
    """
    return df.select(*[F.col(f"`{c}`") for c in columns]).persist()


def assembler(features: Sequence[str], out: str = "features", handle_invalid: str = "skip") -> VectorAssembler:
    """Feature vector from columns (M1); ``skip`` drops rows with a null feature (as R's lm)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=handle_invalid)


def linear_regression(label: str, params: RegressionParams = RegressionParams(),
                      features_col: str = "features") -> LinearRegression:
    """Elastic-net linear regression with every parameter honoured, intercept included (M2)."""
    return LinearRegression(featuresCol=features_col, labelCol=label, regParam=params.regParam,
                            elasticNetParam=params.elasticNetParam, maxIter=params.maxIter,
                            tol=params.tol, standardization=params.standardParam,
                            fitIntercept=params.fitIntercept, solver=params.solver)


def fit_linear(df: DataFrame, features: Sequence[str], label: str,
               params: RegressionParams = RegressionParams()) -> PipelineModel:
    """Assemble + regress as a pipeline and fit it (M3)."""
    data = fit_input(df, [*dict.fromkeys([*features, label])])
    try:
        return Pipeline(stages=[assembler(features), linear_regression(label, params)]).fit(data)
    finally:
        data.unpersist()


def coefficients(fitted: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(term, estimate) for every feature and the intercept (M3)."""
    lr = fitted.stages[-1]
    spark = SparkSession.getActiveSession()
    data = [(f, float(c)) for f, c in zip(features, lr.coefficients.toArray())]
    data.append(("(Intercept)", float(lr.intercept)))
    return spark.createDataFrame(data, "term string, estimate double")


def predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """Score rows (M5)."""
    return fitted.transform(df)


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """n, RMSE, MSE, MAE and R^2 in one pass (M6)."""
    err = F.col(label) - F.col(prediction)
    agg = pred.agg(F.count(err).alias("n"), F.avg(err * err).alias("mse"),
                   F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("_sse"),
                   F.var_pop(label).alias("_var"))
    return agg.select("n", F.sqrt("mse").alias("rmse"), "mse", "mae",
                      (1 - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"))


# -- tuning ----------------------------------------------------------------

def param_grid(lr: LinearRegression, params: RegressionParams = RegressionParams(),
               reg=(0.01, 0.1), iters=(10, 50), enet=(0.5, 1.0), tols=(0.0,)) -> list[dict]:
    """The parameter grid around ``params``, duplicates removed (M7)."""
    maps = (ParamGridBuilder()
            .addGrid(lr.regParam, sorted({params.regParam, *reg}))
            .addGrid(lr.maxIter, sorted({params.maxIter, *iters}))
            .addGrid(lr.elasticNetParam, sorted({params.elasticNetParam, *enet}))
            .addGrid(lr.standardization, sorted({params.standardParam, True}))
            .addGrid(lr.tol, sorted({params.tol, *tols}))
            .build())
    seen, out = set(), []
    for m in maps:
        k = tuple(sorted((p.name, v) for p, v in m.items()))
        if k not in seen:
            seen.add(k)
            out.append(m)
    return out


def _named(grid_map: dict) -> dict:
    """A parameter map keyed by names, from one keyed by names or by ML parameters."""
    return {getattr(p, "name", p): v for p, v in grid_map.items()}


def _whole_rows(groups: dict, folds: int, width: int) -> list[moments.Moments]:
    """Moments per fold over the rows that have every column (others are skipped, as by the assembler)."""
    whole = (False,) * width
    return [groups.get((f, whole), moments.total([], width)) for f in range(folds)]


def cross_validate(df: DataFrame, features: Sequence[str], label: str, key: Column | str,
                   grid_maps: list[dict] | None = None,
                   params: RegressionParams = RegressionParams(), folds: int = 3,
                   metric: str = "rmse") -> tuple[DataFrame, dict]:
    """k-fold cross-validation over a grid (M8, M13), from one scan of the table.

    The scan leaves the moments of each fold (:mod:`.moments`).  A fold's training moments
    are the sum of the other folds', every parameter map is fitted on them, and the held-out
    error is a quadratic form of the fold's own moments, so the cost does not depend on the
    number of maps.  Only ``mae`` is no such form: it takes one more scan, for all maps.

    Folds come from the key hash, so they do not depend on the partitioning; a fold without
    rows is left out of the averages.  Maps without an L1 part are solved directly; with one,
    coordinate descent runs ``maxIter`` sweeps at most, down to ``tol``.  Rows with a missing
    feature or label are skipped.  Returns one row per parameter map with its average metric,
    and the best map's parameters (ties: the first) with its fit on all rows.
    """
    if metric not in ("rmse", "mse", "r2", "mae"):
        raise ValueError("metric must be rmse, mse, r2 or mae")
    if grid_maps is None:
        grid_maps = param_grid(linear_regression(label, params), params)
    named = [_named(m) for m in grid_maps]
    full = [dict(regParam=float(m.get("regParam", params.regParam)), maxIter=int(m.get("maxIter", params.maxIter)),
                 elasticNetParam=float(m.get("elasticNetParam", params.elasticNetParam)),
                 standardization=bool(m.get("standardization", params.standardParam)),
                 tol=float(m.get("tol", params.tol))) for m in named]
    columns = [*features, label]
    fold = (split_hash(key, params.seed) % folds).cast("int")
    groups = moments.by_group(df, {i: moments.present(c) for i, c in enumerate(columns)}, {"fold": fold})
    parts = _whole_rows(groups, folds, len(columns))
    if sum(bool(p.n) for p in parts) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")

    def fitted(m: dict, of: moments.Moments):
        return moments.fit(of, m["regParam"], m["elasticNetParam"], m["standardization"], params.fitIntercept,
                           m["maxIter"], m["tol"])

    held = [f for f in range(folds) if parts[f].n]
    train = {f: moments.total((p for g, p in enumerate(parts) if g != f), len(columns)) for f in held}
    models = [{f: fitted(m, train[f]) for f in held} for m in full]
    if metric == "mae":
        errors = _mean_absolute_errors(df, columns, fold, models)
    else:
        errors = [{f: _error(parts[f], *one[f], metric) for f in held} for one in models]
    scores = [sum(e.values()) / len(e) for e in errors]

    rows = [(*m.values(), float(s)) for m, s in zip(full, scores)]
    res = df.sparkSession.createDataFrame(rows, "regParam double, maxIter int, elasticNetParam double, "
                                                f"standardization boolean, tol double, avg_{metric} double")
    best = (max if metric == "r2" else min)(range(len(scores)), key=scores.__getitem__)
    w, b = fitted(full[best], moments.total(parts, len(columns)))
    return res, full[best] | {"fitIntercept": params.fitIntercept, "coefficients": w.tolist(), "intercept": b}


def _error(m: moments.Moments, w, b: float, metric: str) -> float:
    sse = max(moments.squared_error(m, w, b), 0.0)
    if metric == "r2":
        spread = m.scatter[-1, -1]
        return float(1 - sse / spread) if spread else float("nan")
    return (sse / m.n) ** (0.5 if metric == "rmse" else 1)


def _mean_absolute_errors(df: DataFrame, columns: Sequence[str], fold: Column, models: list[dict]) -> list[dict]:
    """Held-out mean absolute error of every model and fold, from one scan."""
    data = df.select(*[moments.present(c).alias(f"v{i}") for i, c in enumerate(columns)], fold.alias("fold")).na.drop()

    def residual(w, b) -> Column:
        return F.col(f"v{len(w)}") - sum((F.lit(float(x)) * F.col(f"v{i}") for i, x in enumerate(w)), F.lit(float(b)))

    def of_fold(one: dict) -> Column:
        err = F.lit(None).cast("double")
        for f, (w, b) in one.items():
            err = F.when(F.col("fold") == f, F.abs(residual(w, b))).otherwise(err)
        return F.avg(err)

    rows = data.groupBy("fold").agg(*[of_fold(one).alias(f"e{i}") for i, one in enumerate(models)]).collect()
    return [{r["fold"]: r[f"e{i}"] for r in rows if r["fold"] in one} for i, one in enumerate(models)]


def explain_params(stage) -> DataFrame:
    """(name, value, doc) of an estimator's or model's parameters."""
    spark = SparkSession.getActiveSession()
    pm = stage.extractParamMap()
    rows = [(p.name, str(v), p.doc) for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)]
    return spark.createDataFrame(rows, "name string, value string, doc string")


# -- OLS with inference (the R analyses) ------------------------------------

def _design(terms: Sequence[str], levels: dict[str, list]) -> list[tuple[str, dict[str, str], list[str]]]:
    """The model's columns: (name, factor levels that it asks for, its numeric parts).

    A factor term has a column per level but the last of its order; in a product every level
    of a factor counts, since the product enters without main effects.
    """
    out = []
    for term in terms:
        parts = term.split(":")
        columns = [("", {}, [])]
        for p in parts:
            if p not in levels:
                more = [(p, {}, [p])]
            else:
                kept = levels[p][:-1] if len(parts) == 1 else levels[p]
                more = [(f"{p}_{v}", {p: v}, []) for v in kept]
            # a factor asked for two different levels at once never is: such a column is left out
            columns = [(f"{a}:{b}" if a else b, f | g, x + y) for a, f, x in columns for b, g, y in more
                       if all(f[k] == v for k, v in g.items() if k in f)]
        out += columns
    return out


def least_squares_models(df: DataFrame, label: str, models: Mapping[str, Sequence[str]],
                         factor_order: str = "alphabetDesc") -> DataFrame:
    """Ordinary least squares with inference for several models of one label, from one scan.

    The scan leaves the moments of all models' numeric columns and products per combination
    of factor levels; each model's cross-products are put together from those cells, with
    exactly the rows that have every column it uses (R's ``na.omit``).  A term that the terms
    before it explain is aliased: it has null figures, as R's NA, and the others are fitted
    without it.  Output: model, term, estimate, std_error, t_value, p_value, r2, n.
    """
    orders = {"alphabetDesc": (lambda c: c[0], True), "alphabetAsc": (lambda c: c[0], False),
              "frequencyDesc": (lambda c: (-c[1], c[0]), False), "frequencyAsc": (lambda c: (c[1], c[0]), False)}
    if factor_order not in orders:
        raise ValueError(f"factor_order must be one of {sorted(orders)}")
    used = [*dict.fromkeys(p for terms in models.values() for t in terms for p in t.split(":"))]
    factors = [c for c in used if isinstance(df.schema[c].dataType, T.StringType)]
    numeric = {":".join(x): x for terms in models.values() for t in terms
               if (x := [p for p in t.split(":") if p not in factors])}
    names = [*numeric, None]  # the label comes last
    columns = {}
    for k, parts in numeric.items():
        product = moments.present(parts[0])
        for p in parts[1:]:
            product = product * moments.present(p)
        columns[k] = product
    cells = moments.by_group(df, columns | {None: moments.present(label)}, {f: _quoted(f) for f in factors})

    rows = []
    for name, terms in models.items():
        own = {p for t in terms for p in t.split(":")}
        keys = {":".join(x) for t in terms if (x := [p for p in t.split(":") if p not in factors])} | {None}
        mine = {k: m for k, m in cells.items()
                if not any(gone and c in keys for c, gone in zip(names, k[-1]))
                and all(v is not None for f, v in zip(factors, k) if f in own)}
        if not mine:
            raise ValueError(f"no rows to fit in model {name}")
        levels = {}
        for at, f in enumerate(factors):
            if f in own:
                counts: dict = {}
                for k, m in mine.items():
                    counts[k[at]] = counts.get(k[at], 0) + m.n
                order, reverse = orders[factor_order]
                levels[f] = [v for v, _ in sorted(counts.items(), key=order, reverse=reverse)]
        design = _design(terms, levels)
        sums = moments.total([], len(design) + 1)
        for k, m in mine.items():
            here = dict(zip(factors, k))
            matrix, shift = np.zeros((len(design) + 1, len(names))), np.zeros(len(design) + 1)
            matrix[-1, -1] = 1
            for i, (_, asked, parts) in enumerate(design):
                if all(here[f] == v for f, v in asked.items()):
                    if parts:
                        matrix[i, names.index(":".join(parts))] = 1
                    else:
                        shift[i] = 1
            sums = sums + m.mapped(matrix, shift)
        found = moments.least_squares(sums)
        rows += [(name, t, *(found[c][i] for c in ("estimate", "std_error", "t_value", "p_value")), found["r2"], found["n"])
                 for i, t in enumerate([*(d[0] for d in design), "(Intercept)"])]
    return df.sparkSession.createDataFrame(rows, "model string, term string, estimate double, std_error double, "
                                                 "t_value double, p_value double, r2 double, n long")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ols_summary(df: DataFrame, label: str, terms: Sequence[str], model_name: str | None = None,
                factor_order: str = "alphabetDesc") -> DataFrame:
    """Ordinary least squares with standard errors, t and p values.

    ``terms`` are R-style formula terms (``a``, ``a:b``) over R-safe names
    (:func:`panelstats.sources.io.safe_names`).  String columns are factors;
    ``alphabetDesc`` makes the alphabetically first level the reference, as R
    does.  See :func:`least_squares_models`.
    """
    return least_squares_models(df, label, {model_name or f"{label} ~ {' + '.join(terms)}": terms}, factor_order)


def interaction_models(df: DataFrame, label: str, covariates: Sequence[str], base: str,
                       features: Sequence[str]) -> DataFrame:
    """One adjusted model per feature: ``label ~ covariates + base:feature`` (M11, M12), all from one scan.

    The interaction enters without the feature's main effect, as in the study.
    """
    return least_squares_models(df, label, {f: [*covariates, f"{base}:{f}"] for f in features})
