import datetime as dt

from pyspark.sql import functions as F

from panelstats.operators import panel


def test_game_filter_drops_limit_and_null(spark):
    df = spark.createDataFrame([(1999,), (2000,), (None,), (5,)], "q int")
    assert sorted(r[0] for r in panel.drop_out_of_scope(df, "q", 2000).collect()) == [5, 1999]


def test_keep_participants_strictly_more_than_limit(spark):
    rows = [("P25", a) for a in range(25)] + [("P26", a) for a in range(26)] + [("P26", 3)]
    df = spark.createDataFrame(rows, "participantUUID string, assessmentNumber int")
    kept = panel.keep_participants(df, min_exclusive=25)
    assert {r[0] for r in kept.collect()} == {"P26"}
    assert kept.count() == 27
    with_n = panel.keep_participants(df, min_exclusive=25, with_count=True)
    assert {r["totalAssessments"] for r in with_n.collect()} == {26}


def _ts(m):
    return dt.datetime(2020, 1, 1, 0, m)


def test_pivot_earliest_answer_wins_and_tie_break(spark):
    rows = [
        ("P1", 1, "q1", "late", _ts(5), 1),
        ("P1", 1, "q1", "early", _ts(1), 9),
        ("P1", 1, "q2", "b", _ts(3), 2),
        ("P1", 1, "q2", "a", _ts(3), 1),  # same time: lower id wins
        ("P1", 2, "q1", None, _ts(0), 0),  # earliest answer is null: stays null
        ("P1", 2, "q1", "x", _ts(1), 1),
    ]
    df = spark.createDataFrame(rows, "p string, a int, q string, v string, t timestamp, id int")
    w = panel.pivot_first(df, ["p", "a"], "q", "v", ["t", "id"], ["q1", "q2", "q3"])
    got = {r["a"]: (r["q1"], r["q2"], r["q3"]) for r in w.collect()}
    assert got == {1: ("early", "a", None), 2: (None, None, None)}


def test_pivot_discovers_values_in_binary_order(spark):
    df = spark.createDataFrame([("P", "b", 1, 1), ("P", "A", 2, 2)], "p string, q string, v int, t int")
    w = panel.pivot_first(df, ["p"], "q", "v", ["t"])
    assert w.columns == ["p", "A", "b"]


def test_pivot_rows_equal_distinct_groups_two_geotags_two_rows(spark):
    rows = [("P", 1, "g1", "q", "x", 1), ("P", 1, "g2", "q", "y", 2), ("P", 2, None, "q", "z", 3),
            ("P", 2, None, "r", "w", 4)]
    df = spark.createDataFrame(rows, "p string, a int, g string, q string, v string, t int")
    w = panel.pivot_first(df, ["p", "a", "g"], "q", "v", ["t"], ["q", "r"])
    assert w.count() == 3
    assert panel.distinct_groups(df, ["p", "a", "g"]).first()["n_groups"] == 3


def test_pivot_max_sandbox(spark):
    from panelstats.functions.columns import first_non_null

    df = spark.createDataFrame([("A", "X", 6, None), ("B", "Z", None, 5), ("C", "Y", 4, None)],
                               "col1 string, col2 string, col3 int, col4 int")
    df = df.withColumn("newCol", F.concat("col1", "col2")).withColumn("value", first_non_null("col3", "col4"))
    p = panel.pivot_agg(df, ["col1", "col2", "col3", "col4", "newCol"], "newCol", ["AX", "BZ", "CY"],
                        F.max("value"))
    got = [tuple(r) for r in p.orderBy("newCol").drop("newCol").collect()]
    assert got == [("A", "X", 6, None, 6, None, None), ("B", "Z", None, 5, None, 5, None),
                   ("C", "Y", 4, None, None, None, 4)]


def test_select_prefixed(spark):
    df = spark.createDataFrame([(1, 0, "a", "b", "c")], ["participantUUID", "assessmentNumber", "001_x", "101_y", "002_z"])
    out = panel.select_prefixed(df, ["participantUUID", "assessmentNumber"], "0")
    assert out.columns == ["participantUUID", "assessmentNumber", "001_x", "002_z"]


def test_baseline_momentary_split(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (-1,), (None,)], "assessmentNumber int")
    assert panel.baseline_rows(df).count() == 1
    assert panel.momentary_rows(df).count() == 2


def test_spread_baseline_and_duplicate_keys(spark):
    mom = spark.createDataFrame([("P1", 1), ("P1", 2), ("P2", 1), ("P9", 1)], "mp string, a int")
    base = spark.createDataFrame([("P1", 10.0), ("P2", 20.0), ("P3", 30.0)], "p string, b double")
    j = panel.spread_baseline(mom, base, "mp", "p")
    assert sorted((r["mp"], r["a"], r["b"]) for r in j.collect()) == [("P1", 1, 10.0), ("P1", 2, 10.0), ("P2", 1, 20.0)]
    assert panel.duplicate_keys(base, "p").count() == 0
    dup = base.unionByName(spark.createDataFrame([("P1", 11.0)], "p string, b double"))
    assert [r["p"] for r in panel.duplicate_keys(dup, "p").collect()] == ["P1"]


def test_answered(spark):
    df = spark.createDataFrame([("a",), (None,)], "`135_x` string")
    assert panel.answered(df, "135_x").count() == 1


def test_qualify_assessments_equals_join_form(spark):
    rows = ([("P25", a, "g") for a in range(25)] + [("P26", a, "g") for a in range(26)]
            + [("P26", 3, "h"), ("P27", None, "g")] + [("P27", a, "g") for a in range(25)]
            + [(None, a, "g") for a in range(30)])
    df = spark.createDataFrame(rows, "participantUUID string, assessmentNumber int, geo string")
    a = sorted(map(tuple, panel.keep_participants(df).collect()), key=str)
    b = sorted(map(tuple, panel.qualify_assessments(df).collect()), key=str)
    assert a == b and {r[0] for r in a} == {"P26"}
    c = panel.qualify_assessments(df, min_exclusive=24, with_count=True).collect()
    assert {(r[0], r["totalAssessments"]) for r in c} == {("P25", 25), ("P26", 26), ("P27", 25)}


def test_checked_broadcast_only_below_bound(spark):
    rows = [("P26", a) for a in range(26)] + [("P1", 0)]
    df = spark.createDataFrame(rows, "participantUUID string, assessmentNumber int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = panel.keep_participants(df, broadcast_rows=10)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()
        assert small.count() == 26
        big = panel.keep_participants(df, broadcast_rows=0)
        assert "BroadcastHashJoin" not in big._jdf.queryExecution().sparkPlan().toString()
        assert big.count() == 26
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    base = spark.createDataFrame([("P26", 1.0)], "p string, b double")
    assert panel.spread_baseline(df, base, "participantUUID", "p", broadcast_rows=5).count() == 26


def test_salted_join_same_rows_and_hot_key_spread(spark):
    rows = [("hot", i) for i in range(400)] + [("a", 1), ("b", 2), ("zz", 3)]
    mom = spark.createDataFrame(rows, "p string, a int")
    base = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("b", 3.0), ("c", 4.0)], "k string, v double")
    plain = sorted(map(tuple, panel.spread_baseline(mom, base, "p", "k").collect()))
    salted_df = panel.spread_baseline(mom, base, "p", "k", salt_buckets=8, salt_by=["p", "a"])
    assert sorted(map(tuple, salted_df.collect())) == plain and len(plain) == 402
    assert salted_df.columns == ["p", "a", "k", "v"]
    # the hot key's rows carry several salts
    from pyspark.sql import functions as F

    salts = mom.where("p = 'hot'").select(F.pmod(F.xxhash64("p", "a"), F.lit(8)).alias("s")).distinct().count()
    assert salts == 8
    semi = panel.salted_join(mom, base, [("p", "k")], "left_semi", 4, ["a"])
    assert semi.count() == 402 and semi.columns == ["p", "a"]


def test_salting_spreads_a_hot_participant_across_partitions(spark):
    from pyspark.sql import functions as F

    hot = [("hot", i) for i in range(3000)]
    mom = spark.createDataFrame(hot + [(f"p{i}", 1) for i in range(200)], "p string, a int")
    base = spark.createDataFrame([("hot", 0.0)] + [(f"p{i}", float(i)) for i in range(200)], "k string, v double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def parts(df):
            return (df.where("p = 'hot'").select(F.spark_partition_id().alias("pid")).distinct().count())

        assert parts(panel.spread_baseline(mom, base, "p", "k")) == 1
        assert parts(panel.spread_baseline(mom, base, "p", "k", salt_buckets=8, salt_by=["p", "a"])) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_spread_baseline_broadcasts_small_baseline_else_salts(spark):
    mom = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "p string, a int")
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    small = panel.spread_baseline(mom, base, "p", "k", broadcast_rows=10, salt_buckets=4, salt_by=["a"])
    plan = small._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "__salt" not in plan
    big = panel.spread_baseline(mom, base, "p", "k", broadcast_rows=1, salt_buckets=4, salt_by=["a"])
    assert "__salt" in big._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))


def test_pivot_first_rejects_empty_value_list(spark):
    import pytest

    df = spark.createDataFrame([("P", "q", 1, 1)], "p string, q string, v int, t int")
    with pytest.raises(ValueError):
        panel.pivot_first(df, ["p"], "q", "v", ["t"], [])


def test_only_hot_keys_are_salted(spark):
    """The baseline's rows are written participants + hot keys x (salts - 1) times, and a hot key is found
    among many cold ones."""
    from pyspark.sql import functions as F

    n = 30_000
    mom = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit("warm"))
                                .when(F.col("id") % 500 == 2, F.lit(None).cast("string"))
                                .otherwise(F.concat(F.lit("p"), F.col("id"))).alias("p"), F.col("id").alias("a"))
    assert sorted(panel.hot_keys(mom, "p")) == ["hot", "warm"]
    assert panel.hot_keys(mom, "p", share=0.1) == ["hot"] and panel.hot_keys(mom.limit(0), "p") == []
    base = mom.select(F.col("p").alias("k")).distinct().where("k is not null").withColumn("v", F.length("k"))
    joined = panel.spread_baseline(mom, base, "p", "k", broadcast_rows=1, salt_buckets=8, salt_by=["a"])
    assert joined.count() == mom.where("p is not null").count()
    # the replicated side as the plan has it
    rows = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in rows
    salts = base.select(F.explode(F.when(F.col("k").isin("hot", "warm"), F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))))
    assert salts.count() == base.count() + 2 * 7


def test_hot_keys_of_whole_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert panel.hot_keys(df, "k", share=0.05) == ["-1"]
    one = df.distinct().withColumnRenamed("k", "j")
    assert panel.salted_join(df, one, [("k", "j")], "inner", 4, ["k"], hot=["-1"]).count() == 5000
