"""Association statistics: Pearson correlation and Goodman-Kruskal gamma.

Gamma is computed from the contingency table, the only part that touches the
data: one scan emits (pair, x level, y level) for every requested column pair
and one aggregate counts the cells (partial aggregation map-side, so only
cells are shuffled).  Concordant and discordant masses then come from
dominance counts over the cells that occur (:mod:`.dominance`): no cell is
paired with every other cell, and no grid of all levels is built, so columns
with millions of values work like answer scales.

Notation (Agresti, *Categorical Data Analysis*): for cell (i, j) with count
n_ij, A_ij is the count of cells strictly above-left or below-right (concordant
with it) and D_ij those below-left or above-right (discordant).  P = sum n A and
Q = sum n D count each untied pair twice.  gamma = (P - Q) / (P + Q); its
asymptotic standard error is 4 / (P + Q)^2 * sqrt(sum n (Q A - P D)^2)
(Goodman and Kruskal 1963).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import handover
from . import dominance


def _c(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for several column pairs in one pass (B1).

    Rows where either value is null are skipped (R's ``cor`` would return NA);
    ``n_<name>`` reports how many rows were used.
    """
    names = names or [f"{x}__{y}" for x, y in pairs]
    aggs = []
    for (x, y), n in zip(pairs, names):
        xv, yv = _c(x).try_cast("double"), _c(y).try_cast("double")
        aggs += [F.corr(xv, yv).alias(f"r_{n}"),
                 F.count_if(xv.isNotNull() & yv.isNotNull()).alias(f"n_{n}")]
    return df.agg(*aggs)


def _level(df: DataFrame, c: str, order: Sequence | None) -> tuple[Column, Column]:
    """A sortable (numeric, text) form of a level; one of the two is always null."""
    col = _c(c)
    if order is not None:
        rank = None
        for i, v in enumerate(order):
            rank = F.when(col == F.lit(v), F.lit(float(i))) if rank is None else rank.when(col == F.lit(v), F.lit(float(i)))
        return rank, F.lit(None).cast("string")
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.NumericType):
        return col.cast("double"), F.lit(None).cast("string")
    return F.lit(None).cast("double"), col.cast("string")


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]],
                levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Cell counts for every column pair in one scan: (pair, xn, xs, yn, ys, n).

    Rows with a missing x or y are left out (as ``table`` does).  With
    ``levels`` a column's answers are ranked by the given order; answers not in
    it are treated as missing.
    """
    levels = levels or {}
    items = []
    for i, (x, y) in enumerate(pairs):
        xn, xs = _level(df, x, levels.get(x))
        yn, ys = _level(df, y, levels.get(y))
        items.append(F.struct(F.lit(i).alias("pair"), xn.alias("xn"), xs.alias("xs"),
                              yn.alias("yn"), ys.alias("ys")))
    if len(items) == 1:
        long = df.select(items[0].alias("__s")).select("__s.*")
    else:
        long = df.select(F.inline(F.array(*items)))
    present = ((F.col("xn").isNotNull() | F.col("xs").isNotNull())
               & (F.col("yn").isNotNull() | F.col("ys").isNotNull()))
    return (long.where(present).groupBy("pair", "xn", "xs", "yn", "ys")
            .agg(F.count(F.lit(1)).cast("double").alias("n")))


def concordance(cells: DataFrame) -> DataFrame:
    """Per cell of every pair's table: count n, concordant mass A and discordant mass D.

    Cells are ranked by (x, y descending) and by (y, x descending): of two cells the one
    that is smaller in both ranks is the one with the strictly smaller x and y.  So the mass
    below-left of a cell is a dominance count (:mod:`.dominance`), and the other three
    quadrants follow from it, the marginal counts and the running masses along both ranks.
    The work is cells x log(cells), only cells that occur take part, and no task gathers a
    pair's table.  Runs jobs: the cells and both rankings are stored.
    """
    cells = handover(cells, "contingency_cells")
    n = cells.count()
    g = _measured_in_one_strip(cells, n) if n <= 1 << dominance.MOST_DIGITS else _measured_in_strips(cells, n)
    c = F.col
    # ties: of the same x those with a larger y come before it in px, of the same y those with a larger x in py
    x_tie_above, y_tie_right = c("mx") - c("sx"), c("my") - c("sy")
    above_left = c("sx") - c("low") - (c("ny") - c("n") - y_tie_right)
    below_right = c("sy") - c("low") - (c("nx") - c("n") - x_tie_above)
    above_right = c("total") - c("sx") - c("nx") - below_right - y_tie_right
    return g.select("pair", "n", (c("low") + above_right).alias("A"), (above_left + below_right).alias("D"))


_X, _Y = ("xn", "xs"), ("yn", "ys")


def _up(level: Sequence[str]) -> list[Column]:
    return [F.col(v).asc_nulls_first() for v in level]


def _down(level: Sequence[str]) -> list[Column]:
    return [F.col(v).desc_nulls_last() for v in level]


def _measured_in_strips(cells: DataFrame, n: int) -> DataFrame:
    """Per cell: ``low`` (mass below-left), ``total`` of the pair, and per axis the mass of the
    cell's level (``nx``), of smaller levels (``sx``) and before the cell in its rank (``mx``)."""
    parts = max(8, min(512, n >> dominance.MOST_DIGITS))
    g = dominance.ranked(cells, [F.col("pair"), *_up(_X), *_down(_Y)], "px", parts)
    g = dominance.ranked(g, [F.col("pair"), *_up(_Y), *_down(_X)], "py", parts)
    g = handover(dominance.dominated(g, "pair", "px", "py", "n", n, "low"), "dominance_masses")
    stored = g
    for rank, level, mark in (("px", _X, "x"), ("py", _Y, "y")):
        masses = lambda rows: dominance.mass_before(rows, "pair", rank, "n", dominance.strip_digits(n), f"m{mark}")  # noqa: B023, E731
        names = [f"__{v}" for v in level]
        levels = dominance.small(masses(stored).groupBy("pair", *[F.col(v).alias(w) for v, w in zip(level, names)])
                                 .agg(F.sum("n").alias(f"n{mark}"), F.min(f"m{mark}").alias(f"s{mark}"))
                                 .withColumnRenamed("pair", "__pair"))
        same = F.col("pair") == F.col("__pair")
        for v, w in zip(level, names):
            same = same & F.col(v).eqNullSafe(F.col(w))
        g = masses(g).join(levels, same).drop("__pair", *names)
    return g.join(F.broadcast(cells.groupBy("pair").agg(F.sum("n").alias("total"))), "pair")  # one row per column pair


def _measured_in_one_strip(cells: DataFrame, n: int) -> DataFrame:
    """The columns of :func:`_measured_in_strips` where all cells together are one strip at most:
    windows over a pair are bounded by that, and one exchange serves them all."""
    pair = Window.partitionBy("pair")
    g = cells
    for rank, order in (("px", [*_up(_X), *_down(_Y)]), ("py", [*_up(_Y), *_down(_X)])):
        g = g.withColumn(rank, F.row_number().over(pair.orderBy(*order)).cast("long") - 1)
    for rank, level, mark in (("px", _X, "x"), ("py", _Y, "y")):
        same = Window.partitionBy("pair", *level)
        before = pair.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn(f"m{mark}", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
        g = g.withColumn(f"n{mark}", F.sum("n").over(same)).withColumn(f"s{mark}", F.min(f"m{mark}").over(same))
    g = g.withColumn("total", F.sum("n").over(pair))
    return dominance.with_smaller_in_both(g, ["pair"], "px", max(n - 1, 1).bit_length(), "py", "n", ["pair", "px"], "low")


def gamma_from_cells(cells: DataFrame, level: float | None = 0.95) -> DataFrame:
    """Gamma (and with ``level`` its ASE and confidence interval) per pair."""
    g = concordance(cells)
    if level is not None:  # the deviations need both totals first
        g = handover(g, "concordance")
    out = g.groupBy("pair").agg(F.sum(F.col("n") * F.col("A")).alias("P"), F.sum(F.col("n") * F.col("D")).alias("Q"),
                                F.sum("n").alias("n_obs"))
    # No untied pair at all (P + Q = 0): gamma is undefined and comes out null.
    gamma_ = F.try_divide(F.col("P") - F.col("Q"), F.col("P") + F.col("Q")).alias("gamma")
    if level is None:
        return out.select("pair", "n_obs", "P", "Q", gamma_)
    dev = F.col("n") * F.pow(F.col("Q") * F.col("A") - F.col("P") * F.col("D"), 2)
    spread = g.join(F.broadcast(out), "pair").groupBy("pair").agg(F.sum(dev).alias("S"))
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    ase = F.try_divide(F.lit(4.0), F.pow(F.col("P") + F.col("Q"), 2)) * F.sqrt("S")
    return (out.join(F.broadcast(spread), "pair").select("pair", "n_obs", "P", "Q", gamma_, ase.alias("ase"))
            .withColumn("lower", F.col("gamma") - F.lit(z) * F.col("ase"))
            .withColumn("upper", F.col("gamma") + F.col("ase") * F.lit(z)))


def gamma(df: DataFrame, pairs: Sequence[tuple[str, str]], level: float | None = 0.95,
          levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Goodman-Kruskal gamma for each (x, y) column pair, from one scan.

    Output: x, y, n_obs, n_concordant, n_discordant (pairs of observations),
    gamma, and with ``level`` the asymptotic standard error and interval.
    """
    pairs = list(pairs)
    cells = contingency(df, pairs, levels)
    res = gamma_from_cells(cells, level)
    xs = F.array(*[F.lit(x) for x, _ in pairs])
    ys = F.array(*[F.lit(y) for _, y in pairs])
    cols = [xs[F.col("pair")].alias("x"), ys[F.col("pair")].alias("y"), "n_obs",
            (F.col("P") / 2).alias("n_concordant"), (F.col("Q") / 2).alias("n_discordant"), "gamma"]
    if level is not None:
        cols += ["ase", "lower", "upper"]
    return res.select(*cols)


def gamma_matrix(df: DataFrame, rows: Sequence[str], cols: Sequence[str], level: float | None = None,
                 levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Gamma for every (row column, column column) combination from one scan."""
    return gamma(df, [(x, y) for x in rows for y in cols], level, levels)
