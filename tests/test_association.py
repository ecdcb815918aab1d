import itertools
import math
import random

import pytest

from panelstats.operators import association


def brute_gamma(pairs):
    c = d = 0
    for (x1, y1), (x2, y2) in itertools.combinations(pairs, 2):
        s = ((x1 > x2) - (x1 < x2)) * ((y1 > y2) - (y1 < y2))
        c += s > 0
        d += s < 0
    return c, d, (c - d) / (c + d)


def delta_ase(pairs):
    """ASE of gamma by numerical differentiation of gamma(p) over cell proportions."""
    xs, ys = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    n = len(pairs)
    cells = {(x, y): 0 for x in xs for y in ys}
    for p in pairs:
        cells[p] += 1
    keys = list(cells)

    def gamma_of(prop):
        pc = pd = 0.0
        for (a, b), (c_, d_) in itertools.product(keys, keys):
            s = ((xs.index(a) > xs.index(c_)) - (xs.index(a) < xs.index(c_))) * \
                ((ys.index(b) > ys.index(d_)) - (ys.index(b) < ys.index(d_)))
            if s > 0:
                pc += prop[(a, b)] * prop[(c_, d_)]
            elif s < 0:
                pd += prop[(a, b)] * prop[(c_, d_)]
        return (pc - pd) / (pc + pd)

    p0 = {k: v / n for k, v in cells.items()}
    g0 = gamma_of(p0)
    h = 1e-6
    phi = {}
    for k in keys:
        p1 = dict(p0)
        p1[k] += h
        phi[k] = (gamma_of(p1) - g0) / h
    mean = sum(p0[k] * phi[k] for k in keys)
    var = sum(p0[k] * (phi[k] - mean) ** 2 for k in keys)
    return g0, math.sqrt(var / n)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gamma_matches_brute_force_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 4), rnd.choice("abcd"), rnd.random()) for _ in range(150)]
    rows = [(x, y if x < 3 else chr(ord(y) + (x > 3))) for x, y, _ in rows]
    df = spark.createDataFrame(rows, "x int, y string")
    got = association.gamma(df, [("x", "y")], level=None).first()
    c, d, g = brute_gamma(rows)
    assert (got["n_concordant"], got["n_discordant"]) == (c, d)
    assert abs(got["gamma"] - g) < 1e-12


def test_gamma_ase_matches_delta_method(spark):
    tab = [[2, 4, 13, 3], [2, 6, 22, 4], [0, 1, 15, 8], [0, 3, 13, 8]]
    rows = [(i, j) for i in range(4) for j in range(4) for _ in range(tab[i][j])]
    df = spark.createDataFrame(rows, "inc int, sat int")
    got = association.gamma(df, [("inc", "sat")], level=0.95).first()
    g0, ase = delta_ase(rows)
    assert abs(got["gamma"] - g0) < 1e-9
    assert abs(got["ase"] - ase) < 1e-4
    assert abs(got["upper"] - (g0 + 1.959963984540054 * got["ase"])) < 1e-12


def test_gamma_matrix_one_scan_many_pairs_with_nulls_and_level_order(spark):
    rnd = random.Random(5)
    levels = ["Poor", "Fair", "Good"]
    rows = [(rnd.choice(levels + [None]), rnd.randint(1, 3), float(rnd.randint(0, 9))) for _ in range(120)]
    df = spark.createDataFrame(rows, "h string, k int, v double")
    out = association.gamma_matrix(df, ["h"], ["k", "v"], levels={"h": levels})
    got = {r["y"]: r["gamma"] for r in out.collect()}
    for y, idx in (("k", 1), ("v", 2)):
        pairs = [(levels.index(r[0]), r[idx]) for r in rows if r[0] is not None and r[idx] is not None]
        assert abs(got[y] - brute_gamma(pairs)[2]) < 1e-12


def test_pearson_skips_nulls(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 6.2), (None, 1.0), (4.0, 7.9)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = association.pearson(df, [("a", "b")], names=["ab"]).first()
    import statistics

    xs, ys = zip(*[p for p in rows if None not in p])
    assert r["n_ab"] == 4 and abs(r["r_ab"] - statistics.correlation(xs, ys)) < 1e-12
