"""Defects found in review stay fixed."""
import pytest

from panelstats.operators import model, panel, stats
from panelstats.operators.codebook import encode_categories
from panelstats.sources.io import safe_names


def test_answer_tally_of_an_empty_table_does_not_depend_on_the_number_of_columns(spark):
    df = spark.createDataFrame([], "a string, b string")
    few = stats.answer_tally(df, ["a", "b"], {"n": "1"}).collect()
    many = stats.answer_tally(df, ["a", "b"], {f"n{i}": str(i) for i in range(300)}).collect()
    assert few == [] and many == []


def test_safe_names_are_distinct(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a b` int, `a-b` int, `a.b.1` int")
    assert len(set(safe_names(df).columns)) == 3


def test_a_small_train_share_is_not_empty(spark):
    train, test = model.holdout_split(spark.range(0, 200_000), "id", 0.9999)
    assert 0 < train.count() < 100 and test.count() > 199_900


def test_terms_keep_level_texts_that_look_like_tokens(spark):
    rows = [(float(i % 7) + (i % 2), ("v9v", "v0v", "x")[i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "y double, f string, x double")
    terms = {r["term"] for r in model.ols_summary(df, "y", ["f", "x"]).collect()}
    assert terms & {"f_v9v", "f_v0v"}


@pytest.mark.parametrize("size", [64, 65])
def test_category_books_of_every_size_agree(spark, size):
    df = spark.createDataFrame([(1, 1.0, "a3"), (2, None, None), (3, 7.5, "zz")], "id int, `x.y` double, t string")
    book = {"1": 7, "1.0": 8} | {f"a{i}": i for i in range(size - 2)}
    out = encode_categories(df, {"x.y": book, "t": book})
    assert out.columns == ["id", "x.y", "t", "x.y_numeric", "t_numeric"]
    assert [tuple(r)[3:] for r in out.orderBy("id").collect()] == [(8, 3), (-1, -1), (-1, -1)]


def test_pivot_null_order_keys_sort_last(spark):
    df = spark.createDataFrame([(1, "q", "late", 5, 1), (1, "q", "unknown", None, 2), (2, "q", "only", None, 3)],
                               "k int, p string, v string, t int, i int")
    for order in (["t"], ["t", "i"]):
        rows = panel.pivot_first(df, ["k"], "p", "v", order).orderBy("k").collect()
        assert [r["q"] for r in rows] == ["late", "only"]


def test_pivot_keeps_groups_without_a_listed_label(spark):
    df = spark.createDataFrame([(1, "other", 1.0, 1), (2, None, 2.0, 1), (None, "q", 3.0, 1)],
                               "k int, p string, v double, t int")
    rows = panel.pivot_first(df, ["k"], "p", "v", ["t"], ["q", "Q"]).collect()
    assert sorted((r[0] or 0, r[1]) for r in rows) == [(0, 3.0), (1, None), (2, None)]


def test_keep_participants_leaves_no_cache(spark):
    df = spark.createDataFrame([(u, d) for u in range(3) for d in range(u + 1)], "u int, d int")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert panel.keep_participants(df, "u", "d", 1, broadcast_rows=10).count() == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_failed_fit_leaves_no_cache(spark):
    empty = spark.createDataFrame([], "y double, x double, f double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for fit in (lambda: model.ols_summary(empty, "y", ["x"]),
                lambda: model.interaction_models(empty, "y", ["x"], "x", ["f"])):
        with pytest.raises(Exception):
            fit()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_pivot_values_given_as_text_of_a_number(spark):
    df = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (2, 3, "c", 1)], "k int, p int, v string, t int")
    rows = panel.pivot_first(df, ["k"], "p", "v", ["t"], ["1", "2"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "b"), (2, None, None)]
