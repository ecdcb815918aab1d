from panelstats.functions.columns import composite_sum, first_non_null, or_missing, products, sparse_columns, value_or_text
from panelstats.functions.labels import clean_label, is_clean_label, pad_id, question_key, sorted_labels


def test_pad_id_never_truncates_and_keeps_null(spark):
    df = spark.createDataFrame([(1,), (53,), (1999,), (None,)], "q int")
    got = [r[0] for r in df.select(pad_id("q")).collect()]
    assert got == ["001", "053", "1999", None]


def test_question_key_and_cleaning(spark):
    df = spark.createDataFrame([(53, "I've been interested in new things."), (1, None)], "q int, t string")
    got = df.select(question_key("q", "t").alias("k"), clean_label(question_key("q", "t")).alias("c")).collect()
    assert got[0]["k"] == "053_I've been interested in new things."
    assert got[0]["c"] == "053_Ive been interested in new things"
    assert got[1]["k"] is None and got[1]["c"] is None


def test_clean_label_removes_all_five_characters(spark):
    df = spark.createDataFrame([("a'b?c,d:e.f",)], "s string")
    assert df.select(clean_label("s")).first()[0] == "abcdef"


def test_is_clean_label(spark):
    df = spark.createDataFrame([("001_Age",), ("_x",), ("a.b",), ("ok label",)], "s string")
    got = [r[0] for r in df.select(is_clean_label("s")).collect()]
    assert got == [True, False, False, True]


def test_sorted_labels_binary_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("a",), (None,)], "s string")
    assert sorted_labels(df, "s") == ["B", "a", "b"]


def test_first_non_null_and_or_missing(spark):
    df = spark.createDataFrame([("no", "yes"), (None, "yes"), (None, None)], "a string, b string")
    got = df.select(first_non_null("a", "b"), or_missing("a")).collect()
    assert [tuple(r) for r in got] == [("no", "no"), ("yes", "NA"), (None, "NA")]


def test_value_or_text(spark):
    df = spark.createDataFrame([("None", "Female"), ("4", "4 times"), (None, "x")], "v string, t string")
    got = [r[0] for r in df.select(value_or_text("v", "t")).collect()]
    assert got == ["Female", "4", None]


def test_composite_null_if_any_item_missing_or_not_numeric(spark):
    df = spark.createDataFrame([("1", "2", "3"), ("1", None, "3"), ("1", "Often", "3")], "a string, b string, c string")
    got = [r[0] for r in df.select(composite_sum(["a", "b", "c"])).collect()]
    assert got == [6.0, None, None]


def test_products_and_sparse_columns(spark):
    df = spark.createDataFrame([(2.0, -1, "x", 5.0)], "b double, f int, k string, v double")
    r = df.withColumns(products("b", {"i": "f"})).select("i", *sparse_columns("k", "v", ["x", "y"])).first()
    assert (r["i"], r["x"], r["y"]) == (-2.0, 5.0, None)


def test_unpadded_keys_sort_in_binary_order(spark):
    df = spark.createDataFrame([(101, "Who is with you right now?"), (8, "How would you rate your mental health overall?"),
                                (102, "What are you doing right now?")], "q int, t string")
    keys = sorted_labels(df.select(question_key("q", "t", width=1).alias("k")), "k")
    assert keys[0] == "101_Who is with you right now?"
    assert keys[1] == "102_What are you doing right now?"
    assert keys[-1] == "8_How would you rate your mental health overall?"
