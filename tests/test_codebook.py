import pytest
from pyspark.sql import types as T

from panelstats.operators.codebook import OrdinalRule, check_rules, encode_categories, id_range, intervals, score_answers
from panelstats.plans import codebooks as cb


def _score(spark, rows, rules=cb.ORDINAL_RULES, **kw):
    df = spark.createDataFrame(rows, "qid int, answer string")
    out = score_answers(df, "qid", "answer", rules, out_col="s", **kw)
    return {(r["qid"], r["answer"]): r["s"] for r in out.collect()}


def test_rule_counts():
    assert len(cb.ORDINAL_RULES) == 52
    assert sum(len(b) for b in cb.BASELINE_BOOKS.values()) == 27
    assert sum(len(b) for b in cb.BASELINE_BOOKS_OLD.values()) == 25
    assert sum(len(b) for b in cb.MOMENTARY_BOOKS.values()) == 17
    check_rules(cb.ORDINAL_RULES)


def test_overlapping_rules_rejected():
    with pytest.raises(ValueError):
        check_rules([OrdinalRule((1, 2), "a", "1"), OrdinalRule((2, 3), "a", "2")])


def test_often_depends_on_question_range(spark):
    got = _score(spark, [(13, "Often"), (31, "Often"), (36, "Often"), (41, "Often"), (40, "Often")])
    assert [got[(q, "Often")] for q in (13, 31, 36, 41, 40)] == ["4", "2", "3", "4", "Often"]


def test_agree_scale_reversed_for_154_to_158(spark):
    got = _score(spark, [(q, "I very much agree") for q in (131, 154, 159)])
    assert [got[(q, "I very much agree")] for q in (131, 154, 159)] == ["5", "1", "5"]


def test_mangled_dates_and_nulls(spark):
    got = _score(spark, [(28, "01-Feb"), (152, "06-Jun"), (28, "05-Jun"), (28, None)])
    assert got[(28, "01-Feb")] == "0" and got[(152, "06-Jun")] == "2"
    assert got[(28, "05-Jun")] == "05-Jun" and got[(28, None)] is None


def test_impulsivity_only_default_minus_one(spark):
    got = _score(spark, [(31, "Often"), (41, "Often")], rules=cb.IMPULSIVITY_RULES, default=-1,
                 score_type=T.IntegerType())
    assert got == {(31, "Often"): 2, (41, "Often"): -1}


def test_scoring_keeps_every_row(spark):
    rows = [(13, "Never")] * 3 + [(999, "x")] * 2
    df = spark.createDataFrame(rows, "qid int, answer string")
    assert score_answers(df, "qid", "answer", cb.ORDINAL_RULES).count() == 5


def test_categorical_codes(spark):
    df = spark.createDataFrame([("Female", "Very poor"), ("unknown", "Good"), (None, None)], [cb.GENDER, cb.PHYSICAL_HEALTH])
    main = encode_categories(df, {k: cb.BASELINE_BOOKS[k] for k in (cb.GENDER, cb.PHYSICAL_HEALTH)}).collect()
    old = encode_categories(df, {cb.PHYSICAL_HEALTH: cb.BASELINE_BOOKS_OLD[cb.PHYSICAL_HEALTH]}).collect()
    assert [(r[cb.GENDER + "_numeric"], r[cb.PHYSICAL_HEALTH + "_numeric"]) for r in main] == [(0, 0), (-1, 3), (-1, -1)]
    assert [r[cb.PHYSICAL_HEALTH + "_numeric"] for r in old] == [-1, 2, -1]


def test_momentary_codes(spark):
    df = spark.createDataFrame([("Indoors", "not sure"), ("Outdoors", "yes"), ("NA", "NA")], [cb.INDOORS, cb.SKY])
    out = encode_categories(df, {cb.INDOORS: cb.MOMENTARY_BOOKS[cb.INDOORS], cb.SKY: cb.MOMENTARY_BOOKS[cb.SKY]})
    assert [(r[-2], r[-1]) for r in out.collect()] == [(0, 0), (1, 1), (-1, -1)]


def test_missing_none_keeps_null(spark):
    df = spark.createDataFrame([("x",)], [cb.GENDER])
    r = encode_categories(df, {cb.GENDER: cb.BASELINE_BOOKS[cb.GENDER]}, missing=None).first()
    assert r[1] is None


def test_null_id_gives_null_score_null_answer_gets_default(spark):
    got = _score(spark, [(None, "Often"), (13, None)])
    assert got == {(None, "Often"): None, (13, None): None}
    got = _score(spark, [(None, "Often"), (31, None)], rules=cb.IMPULSIVITY_RULES, default=-1,
                 score_type=T.IntegerType())
    assert got == {(None, "Often"): None, (31, None): -1}


def test_large_book_uses_a_lookup_join_with_same_codes(spark):
    from panelstats.operators import codebook

    book = {f"a{i}": i for i in range(200)}
    df = spark.createDataFrame([("a5",), ("a199",), ("zz",), (None,)], "c string")
    out = codebook.encode_categories(df, {"c": book})
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([("a5", 5), ("a199", 199), ("zz", -1), (None, -1)], key=repr)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["c", "c_numeric"]


def test_ranges_are_never_expanded(spark):
    rules = [OrdinalRule(id_range(1, 10**9), "yes", "1"), OrdinalRule(id_range(10**9 + 1, 10**12), "yes", "2"),
             OrdinalRule(range(0, -5), "no", "0"), OrdinalRule(id_range(5, 7), "no", "3")]
    with pytest.raises(ValueError):
        check_rules(rules)  # an empty range
    rules.pop(2)
    assert len(check_rules(rules)) == 3
    df = spark.createDataFrame([(q, a) for q in (0, 1, 10**9, 10**9 + 1, 10**12, 10**12 + 1, 6, None) for a in ("yes", "no", None)],
                               "qid long, answer string")
    got = {(r["qid"], r["answer"]): r["s"] for r in score_answers(df, "qid", "answer", rules, out_col="s").collect()}
    assert [got[q, "yes"] for q in (0, 1, 10**9, 10**9 + 1, 10**12, 10**12 + 1, 6, None)] == ["yes", "1", "1", "2", "2", "yes", "1", None]
    assert got[6, "no"] == "3" and got[1, "no"] == "no" and got[6, None] is None
    plan = score_answers(df, "qid", "answer", rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Generate" not in plan


def test_a_question_in_several_tuples_and_gaps():
    assert intervals(OrdinalRule((5, 1, 2, 9), "a", "1")) == [(1, 2), (5, 5), (9, 9)]
    assert intervals(OrdinalRule(range(3, 9, 2), "a", "1")) == [(3, 3), (5, 5), (7, 7)]
    for rules in ([OrdinalRule((1, 1), "a", "1")], [OrdinalRule(id_range(1, 50), "a", "1"), OrdinalRule((50,), "a", "1")]):
        with pytest.raises(ValueError):
            check_rules(rules)


@pytest.mark.parametrize("n", [1, 64, 65, 1000])
def test_scanned_and_searched_books_agree(spark, n):
    """Intervals of every other ten ids: one answer with n of them, one with a single one."""
    rules = [OrdinalRule(id_range(20 * i, 20 * i + 9), "a", str(i)) for i in range(n)] + [OrdinalRule((7,), "b", "x")]
    df = spark.range(-3, 20 * n + 30).selectExpr("id AS qid", "explode(array('a', 'b', 'c', null)) AS answer")
    want = {(q, a): None if a is None else str(q // 20) if a == "a" and 0 <= q < 20 * n and q % 20 < 10 else "x" if (q, a) == (7, "b") else a
            for q in range(-3, 20 * n + 30) for a in ("a", "b", "c", None)}
    out = score_answers(df, "qid", "answer", rules, out_col="s")
    assert {(r["qid"], r["answer"]): r["s"] for r in out.collect()} == want and out.columns == ["qid", "answer", "s"]
