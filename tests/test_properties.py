"""Property tests: operators against plain-Python implementations on random input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelstats.operators import panel, stats

ROW = st.tuples(st.sampled_from(["P1", "P2", "P3"]), st.integers(0, 3), st.sampled_from(["q1", "q2", "q3"]),
                st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), st.integers(0, 5), st.integers(0, 10**6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=40, unique_by=lambda r: r[5]))
def test_pivot_first_matches_python(spark, rows):
    df = spark.createDataFrame(rows, "p string, a int, q string, v string, t int, id long")
    got = {(r["p"], r["a"]): (r["q1"], r["q2"], r["q3"])
           for r in panel.pivot_first(df, ["p", "a"], "q", "v", ["t", "id"], ["q1", "q2", "q3"]).collect()}
    want = {}
    for p, a, q, v, t, i in rows:
        cell = want.setdefault((p, a), {})
        if q not in cell or (t, i) < cell[q][0]:
            cell[q] = ((t, i), v)
    want = {k: tuple(c[q][1] if q in c else None for q in ("q1", "q2", "q3")) for k, c in want.items()}
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=40), st.integers(0, 3))
def test_qualify_and_counts_match_python(spark, rows, limit):
    df = spark.createDataFrame(rows, "p string, a int, q string, v string, t int, id long")
    days = {}
    for p, a, *_ in rows:
        days.setdefault(p, set()).add(a)
    kept = {p for p, s in days.items() if len(s) > limit}
    got = sorted(map(tuple, panel.qualify_assessments(df, "p", "a", limit).collect()), key=repr)
    assert got == sorted((r for r in rows if r[0] in kept), key=repr)
    per = {r["v"]: r["n_participants"] for r in stats.participants_per_answer(df, "p", "v").collect()}
    want = {}
    for p, _, _, v, *_ in rows:
        want.setdefault(v, set()).add(p)
    assert per == {v: (len(ps) if v is not None else 0) for v, ps in want.items()}


PAIR = st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.sampled_from("abcd")))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PAIR, min_size=3, max_size=40))
def test_gamma_matches_pair_counting(spark, rows):
    from itertools import combinations

    from panelstats.operators import association

    full = [(x, y) for x, y in rows if x is not None and y is not None]
    c = d = 0
    for (x1, y1), (x2, y2) in combinations(full, 2):
        s = ((x1 > x2) - (x1 < x2)) * ((y1 > y2) - (y1 < y2))
        c += s > 0
        d += s < 0
    df = spark.createDataFrame(rows, "x int, y string")
    got = association.gamma(df, [("x", "y")], level=None).collect()
    if not full:
        assert got == []
        return
    r = got[0]
    assert (r["n_obs"], r["n_concordant"], r["n_discordant"]) == (len(full), c, d)
    if c + d:
        assert abs(r["gamma"] - (c - d) / (c + d)) < 1e-12
    else:
        assert r["gamma"] is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["yes", "no", "NA", None]), st.sampled_from(["yes", "not sure", None])),
                min_size=1, max_size=30))
def test_answer_tally_matches_python(spark, rows):
    answers = {"n_yes": "yes", "n_no": "no", "n_not_sure": "not sure", "n_na": "NA"}
    df = spark.createDataFrame(rows, "a string, b string")
    got = {r["question"]: tuple(r)[1:] for r in stats.answer_tally(df, ["a", "b"], answers).collect()}
    for i, q in enumerate(["a", "b"]):
        vals = [r[i] for r in rows]
        assert got[q] == tuple(vals.count(v) for v in answers.values()) + (len(rows),)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([13, 28, 31, 36, 41, 131, 152, 154, 159, 200])),
                          st.one_of(st.none(), st.sampled_from(["Often", "Never", "1-2", "06-Jun", "Not sure",
                                                                "I very much agree", "x"]))),
                min_size=1, max_size=30))
def test_scoring_matches_python_lookup(spark, rows):
    from panelstats.operators.codebook import score_answers
    from panelstats.plans import codebooks as cb

    book = {(i, r.answer): r.score for r in cb.ORDINAL_RULES for i in r.ids}
    df = spark.createDataFrame([(k, q, a) for k, (q, a) in enumerate(rows)], "k int, q int, a string")
    got = {r["k"]: r["s"] for r in score_answers(df, "q", "a", cb.ORDINAL_RULES, out_col="s").collect()}
    want = {k: (None if q is None else book.get((q, a), a)) for k, (q, a) in enumerate(rows)}
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 50)), min_size=1, max_size=40),
       st.integers(2, 9))
def test_salted_join_equals_plain_join(spark, rows, buckets):
    mom = spark.createDataFrame(rows, "p string, a int")
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 4.0)], "k string, v double")
    plain = sorted(map(tuple, panel.spread_baseline(mom, base, "p", "k").collect()), key=repr)
    salted = panel.spread_baseline(mom, base, "p", "k", salt_buckets=buckets, salt_by=["p", "a"])
    assert sorted(map(tuple, salted.collect()), key=repr) == plain
