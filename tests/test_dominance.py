"""Dominance counts, ranks and prefix sums against brute force, and gamma on columns of many values."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.operators import association, dominance
from tests.test_association import brute_gamma


@pytest.mark.parametrize(("n", "digits"), [(1, 3), (37, 3), (300, 3), (300, 6)])
def test_dominated_equals_brute_force(spark, monkeypatch, n, digits):
    monkeypatch.setattr(dominance, "MOST_DIGITS", digits)
    r = np.random.default_rng(n)
    group = np.sort(r.integers(0, 3, n))
    a = np.arange(n)
    b = np.lexsort((r.random(n), group)).argsort()  # unique, contiguous by group
    w = r.integers(1, 9, n).astype(float)
    df = spark.createDataFrame([(int(x[0]), int(x[1]), int(x[2]), float(x[3]))
                                for x in zip(group, a, b, w)], "g int, a long, b long, w double").repartition(5)
    got = {x["a"]: x["m"] for x in dominance.dominated(df, "g", "a", "b", "w", n, "m").collect()}
    want = {int(a[i]): w[(group == group[i]) & (a < a[i]) & (b < b[i])].sum() for i in range(n)}
    assert got == want


def test_ranks_and_masses(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1.5, 2.5, 9.0]), i, float(r.randint(1, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, i int, w double").withColumn("g", F.lit(0))
    out = dominance.ranked(df, [F.col("x").asc_nulls_first(), F.col("i").desc()], "p", 7)
    out = dominance.mass_before(out, "g", "p", "w", 3, "m").collect()
    order = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, -t[1]))
    at = {t[1]: k for k, t in enumerate(order)}
    before = np.concatenate([[0], np.cumsum([t[2] for t in order])])
    assert {x["i"]: (x["p"], x["m"]) for x in out} == {i: (k, before[k]) for i, k in at.items()}


@pytest.mark.parametrize("digits", [2, 16])
def test_gamma_of_many_values_with_ties_and_several_pairs(spark, monkeypatch, digits):
    monkeypatch.setattr(dominance, "MOST_DIGITS", max(digits, 3))
    monkeypatch.setattr(dominance, "BROADCAST_ROWS", 10 if digits == 2 else 500_000)
    r = random.Random(digits)
    rows = [(r.choice([None, *range(60)]), round(r.gauss(0, 1), 2), r.choice("abc"), float(r.randint(0, 1))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d double")
    pairs = [("a", "b"), ("b", "c"), ("d", "b"), ("d", "c")]
    got = {(x["x"], x["y"]): x for x in association.gamma(df, pairs).collect()}
    for x, y in pairs:
        i, j = "abcd".index(x), "abcd".index(y)
        c, d, g = brute_gamma([(t[i], t[j]) for t in rows if t[i] is not None and t[j] is not None])
        m = got[x, y]
        assert (m["n_concordant"], m["n_discordant"]) == (c, d) and abs(m["gamma"] - g) < 1e-12 and m["ase"] > 0


def test_gamma_of_nothing(spark):
    assert association.gamma(spark.createDataFrame([], "a int, b int"), [("a", "b")]).count() == 0
    only = association.gamma(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), [("a", "b")]).first()
    assert only["gamma"] is None and only["n_obs"] == 2


def test_rows_of_a_strip_are_moved_once(spark, monkeypatch):
    """Per digit of a rank a row is counted in its task; no copy of it is made and shuffled."""
    monkeypatch.setattr(dominance, "MOST_DIGITS", 4)
    df = spark.range(400).select(F.lit(0).alias("g"), F.col("id").alias("a"), ((F.col("id") * 7) % 400).alias("b"), F.lit(1.0).alias("w"))
    out = dominance.dominated(df, "g", "a", "b", "w", 400, "m")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 2
    b = np.arange(400) * 7 % 400
    assert {x["a"]: x["m"] for x in out.collect()} == {i: float((b[:i] < b[i]).sum()) for i in range(400)}
