"""Additive moments: what a linear model needs from its table, in one scan.

A table is reduced once to count, means and central cross-products of its numeric columns
(:class:`Moments`), per group of some key (a fold, or a combination of factor levels and
missing values).  Moments of disjoint groups add up exactly, and those of linear maps of the
columns follow without the rows, so every fit, every fold and every model that shares the
columns is computed from that one small result:

* cross-validation: the training moments of a fold are the sum of the other folds', its
  held-out error is a quadratic form of its own;
* elastic net: coordinate descent on the k x k correlation matrix;
* ordinary least squares with factors and products: dummies are constant within a cell of
  factor levels, so a model's cross-product matrix is put together from the cells, and the
  sweep operator gives estimates, errors, t and p values of each model.

Only groups x k^2 numbers leave the executors.  A task reduces its own rows in blocks (Arrow,
numpy) to central moments and adds up each group's, before the shuffle: no group is gathered in
one task, and large means do not cost digits as sums of raw products would.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose moments may come to the driver; factor levels become model columns, so their
#: combinations are few, and a table with more is refused instead of gathered.
MOST_GROUPS = 100_000
#: Rows that a task reduces at a time, and groups whose moments it holds.
BLOCK_ROWS = 50_000
HELD_GROUPS = 1_000


@dataclass(frozen=True)
class Moments:
    """Row count, means and central cross-products (sums, not averages) of some columns."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n),
                       self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))

    def mapped(self, matrix: np.ndarray, shift: np.ndarray) -> Moments:
        """Moments of ``matrix`` x + ``shift``."""
        return Moments(self.n, matrix @ self.mean + shift, matrix @ self.scatter @ matrix.T)

    def taken(self, columns: Sequence[int]) -> Moments:
        at = list(columns)
        return Moments(self.n, self.mean[at], self.scatter[np.ix_(at, at)])


def total(parts: Iterable[Moments], width: int) -> Moments:
    out = Moments(0.0, np.zeros(width), np.zeros((width, width)))
    for m in parts:
        out = out + m
    return out


def present(c: str | Column) -> Column:
    """The column as a double; NaN counts as missing."""
    v = (F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def by_group(df: DataFrame, columns: Mapping[str, Column], by: Mapping[str, Column]) -> dict[tuple, Moments]:
    """Moments of the named numeric ``columns`` per value of the ``by`` columns, from one scan.

    The last entry of a group's key tells, per column, whether it is missing in the group's
    rows, so a caller leaves out exactly the rows that lack a column it uses; the moments of
    a missing column are zero.
    """
    v = [F.col(f"v{i}") for i in range(len(columns))]
    # a mark per column in a text: a key that Arrow can look up
    data = (df.select(*[c.alias(f"g{i}") for i, c in enumerate(by.values())],
                      *[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())])
            .withColumn("missing", F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in v])))
    width, keys = len(v), [*(f"g{i}" for i in range(len(by))), "missing"]
    schema = T.StructType([*(data.schema[k] for k in keys), T.StructField("n", T.DoubleType()),
                           *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "scatter"))])

    def plus(a, b):
        """As the sum of two :class:`Moments`, which executors need not import."""
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def add(batches, groups: dict) -> list:
        """Adds the moments of some rows to their groups'; returns the types of the keys."""
        import pyarrow as pa

        whole = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(whole.num_rows, np.int64)
        for k in keys:
            found = whole[k].chunk(0).dictionary_encode(null_encoding="encode")
            code = code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        x = np.column_stack([whole[f"v{i}"].fill_null(0.0).to_numpy() for i in range(width)])[order]
        firsts = whole.select(keys).take(order[starts])
        for key, rows in zip(zip(*(c.to_pylist() for c in firsts.columns)), np.split(x, starts[1:])):
            mean = rows.mean(axis=0)
            found = float(len(rows)), mean, (rows - mean).T @ (rows - mean)
            groups[key] = plus(groups[key], found) if key in groups else found
        return [c.type for c in firsts.columns]

    def table(groups: dict, kinds: list):
        import pyarrow as pa

        own = list(groups.values())
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in groups], kind) for i, kind in enumerate(kinds)), pa.array([m[0] for m in own], pa.float64()),
             *(pa.array([m[i].ravel() for m in own], pa.list_(pa.float64())) for i in (1, 2))],
            schema.names)

    def run(batches):
        held, rows, groups, kinds = [], 0, {}, []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                kinds = add(held, groups)
                held, rows = [], 0
            if len(groups) > HELD_GROUPS:
                yield table(groups, kinds)
                groups = {}
        if rows:
            kinds = add(held, groups)
        if groups:
            yield table(groups, kinds)

    def joined(part):
        import pyarrow as pa

        own = [(n, np.array(mean), np.array(scatter).reshape(width, width))
               for n, mean, scatter in zip(*(part[c].to_pylist() for c in ("n", "mean", "scatter")))]
        key = tuple(part[k][0].as_py() for k in keys)
        return pa.Table.from_batches([table({key: reduce(plus, own)}, [part.schema.field(k).type for k in keys])])

    rows = data.mapInArrow(run, schema).groupBy(*keys).applyInArrow(joined, schema).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: factor levels and folds must be few")
    return {(*(r[k] for k in keys[:-1]), tuple(c == "1" for c in r["missing"])):
            Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(width, width)) for r in rows}


# -- regularised fits ----------------------------------------------------------

def fit(m: Moments, reg: float = 0.0, elastic_net: float = 0.0, standardize: bool = True,
        intercept: bool = True, max_iter: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the last column of ``m`` on the others.

    Minimises mean squared error / 2 plus ``reg`` times the elastic-net penalty, in the
    scaling of Spark's linear regression: the label is scaled by its standard deviation and
    the penalty applies to coefficients of scaled features (``standardize``) or of raw ones.
    Without an L1 part the solution is direct; otherwise coordinate descent runs at most
    ``max_iter`` sweeps, until no scaled coefficient moves by more than ``tol``.
    """
    k = len(m.mean) - 1
    if not m.n:
        raise ValueError("no rows to fit")
    sd = np.sqrt(np.diag(m.scatter) / m.n)
    if not k or sd[-1] == 0:  # a constant label: the mean is the model
        return np.zeros(k), float(m.mean[-1]) if intercept else 0.0
    second = m.scatter / m.n
    if not intercept:
        second = second + np.outer(m.mean, m.mean)
    used = np.flatnonzero(sd[:-1] > 0)  # a constant feature gets no coefficient
    s = sd[used]
    r = second[np.ix_(used, used)] / np.outer(s, s)
    c = second[used, -1] / (s * sd[-1])
    weight = np.ones(len(used)) if standardize else 1 / s
    l1 = reg * elastic_net / sd[-1] * weight
    l2 = reg * (1 - elastic_net) / sd[-1] * weight ** 2
    if not l1.any():
        v = np.linalg.lstsq(r + np.diag(l2), c, rcond=None)[0]
    else:
        v = np.zeros(len(used))
        for _ in range(max_iter):
            moved = 0.0
            for j in range(len(used)):
                rest = c[j] - r[j] @ v + r[j, j] * v[j]
                new = math.copysign(max(abs(rest) - l1[j], 0.0), rest) / (r[j, j] + l2[j])
                moved, v[j] = max(moved, abs(new - v[j])), new
            if moved <= tol:
                break
    w = np.zeros(k)
    w[used] = v * sd[-1] / s
    return w, float(m.mean[-1] - w @ m.mean[:-1]) if intercept else 0.0


def squared_error(m: Moments, w: np.ndarray, b: float) -> float:
    """Sum over the rows behind ``m`` of (label - b - w x)^2."""
    z = np.append(-w, 1.0)
    return float(m.n * (z @ m.mean - b) ** 2 + z @ m.scatter @ z)


# -- least squares with inference ------------------------------------------------

def sweep(a: np.ndarray, k: int) -> None:
    """Sweeps the symmetric matrix on its k-th diagonal element, in place."""
    d = a[k, k]
    row = a[k] / d
    column = a[:, k].copy()
    a -= np.outer(column, row)
    a[k] = row
    a[:, k] = -column / d
    a[k, k] = 1 / d


def least_squares(m: Moments, least_pivot: float = 1e-9) -> dict:
    """Ordinary least squares of the last column on the others and an intercept.

    The features are swept in order; one whose variance the features before it explain
    (up to ``least_pivot`` of it) is aliased: it gets no estimate, as in R, and the others'
    inference goes on without it.  Returns estimates, errors, t and p values (the intercept
    last; ``None`` where undefined) and R^2.
    """
    k = len(m.mean) - 1
    if not m.n:
        raise ValueError("no rows to fit")
    scale = np.sqrt(np.where(np.diag(m.scatter) > 0, np.diag(m.scatter), 1.0))
    a = m.scatter / np.outer(scale, scale)
    swept = []
    for j in range(k):
        if m.scatter[j, j] > 0 and a[j, j] > least_pivot:
            sweep(a, j)
            swept.append(j)
    at = np.array(swept, int)
    beta = a[at, -1] * scale[-1] / scale[at]
    error = max(a[-1, -1], 0.0) * scale[-1] ** 2
    free = m.n - len(at) - 1
    inverse = a[np.ix_(at, at)] / np.outer(scale[at], scale[at])
    sigma2 = error / free if free > 0 else math.nan
    variance = np.append(np.diag(inverse), 1 / m.n + m.mean[at] @ inverse @ m.mean[at]) * sigma2
    found = np.append(beta, m.mean[-1] - beta @ m.mean[at])
    none = [None] * (k + 1)
    out = {"estimate": list(none), "std_error": list(none), "t_value": list(none), "p_value": list(none)}
    for j, e, s2 in zip([*swept, k], found, variance):
        out["estimate"][j] = float(e)
        if free > 0:
            s = math.sqrt(max(s2, 0.0))
            out["std_error"][j] = s
            if s > 0:
                out["t_value"][j] = float(e) / s
                out["p_value"][j] = t_tail(float(e) / s, free)
    out["r2"] = float(1 - error / m.scatter[-1, -1]) if m.scatter[-1, -1] > 0 else None
    out["n"] = int(m.n)
    return out


def t_tail(t: float, free: float) -> float:
    """Two-sided tail probability of Student's t: the regularised incomplete beta function
    I_x(free / 2, 1 / 2) at x = free / (free + t^2), by its continued fraction."""
    if free > 1e6:  # the normal tail of a value corrected to order 1 / free
        return math.erfc(abs(t) * (1 - 1 / (4 * free)) / math.sqrt(1 + t * t / (2 * free)) / math.sqrt(2))
    x, y = free / (free + t * t), t * t / (free + t * t)
    a, b = free / 2, 0.5
    if not x:
        return 0.0
    if not y:
        return 1.0
    # log(gamma(a + 1/2) / gamma(a)); by its series where the difference of two logs would lose digits
    grown = math.log(a) / 2 - 1 / (8 * a) + 1 / (192 * a ** 3) if a > 1e3 else math.lgamma(a + b) - math.lgamma(a)
    front = math.exp(grown - math.lgamma(b) - a * math.log1p(t * t / free) + b * math.log(y))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, y) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction 1 / (1 + d1 / (1 + d2 / ...)) of the incomplete beta function,
    from its last used term backwards, with more terms until the value stays."""
    def depth(n: int) -> float:
        value = 1.0
        for i in range(n, 0, -1):
            k = i // 2
            d = (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0
                 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)))
            value = 1.0 + d / value
        return 1.0 / value

    n, last = 16, depth(8)
    while n <= 65_536:
        now = depth(n)
        if abs(now - last) <= 1e-14 * abs(now):
            return now
        n, last = n * 2, now
    return last
