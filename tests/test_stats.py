from panelstats.operators import stats


def _df(spark):
    rows = [("P1", 1, "Female", 30.0, "yes"), ("P1", 2, "Female", 30.0, "no"), ("P2", 1, "Male", 40.0, "NA"),
            ("P3", 1, None, None, "yes"), ("P3", 2, None, None, "not sure")]
    return spark.createDataFrame(rows, "p string, a int, g string, age double, t string")


def test_participants(spark):
    assert stats.participants(_df(spark), "p").first()[0] == 3


def test_participants_per_answer_null_group_counts_zero(spark):
    got = {r["g"]: r["n_participants"] for r in stats.participants_per_answer(_df(spark), "p", "g").collect()}
    assert got == {"Female": 1, "Male": 1, None: 0}


def test_mean_of_distinct(spark):
    assert stats.mean_of_distinct(_df(spark), "p", "age").first()[0] == 35.0


def test_mean_assessments(spark):
    assert abs(stats.mean_assessments(_df(spark), "p", "a").first()[0] - 5 / 3) < 1e-12


def test_describe_sample_sd(spark):
    r = stats.describe(_df(spark), ["age"]).first()
    assert r["n_age"] == 3 and abs(r["mean_age"] - 100 / 3) < 1e-12
    assert abs(r["sd_age"] - (((30 - 100 / 3) ** 2 * 2 + (40 - 100 / 3) ** 2) / 2) ** 0.5) < 1e-9


def test_count_values(spark):
    r = stats.count_values(_df(spark), "t", {"n_yes": "yes", "n_na": "NA"}).first()
    assert (r["n_yes"], r["n_na"]) == (2, 1)


def test_answer_tally_one_row_per_question(spark):
    out = stats.answer_tally(_df(spark), ["t", "g"], {"n_yes": "yes", "n_no": "no", "n_not_sure": "not sure",
                                                      "n_na": "NA"})
    got = {r["question"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"t": (2, 1, 1, 1, 5), "g": (0, 0, 0, 0, 5)}


def test_distinct_per_participant(spark):
    got = {r["p"]: r["n_t"] for r in stats.distinct_per_participant(_df(spark), "p", "t").collect()}
    assert got == {"P1": 2, "P2": 1, "P3": 2}


def test_participants_approximate(spark):
    df = spark.range(0, 5000).selectExpr("id % 1000 AS p")
    assert abs(stats.participants(df, "p", approx_rsd=0.02).first()[0] - 1000) <= 60


def test_multi_column_forms_equal_single_column_forms(spark):
    df = _df(spark)
    multi = {(r["question"], r["answer"]): r["n_participants"]
             for r in stats.participants_per_answers(df, "p", ["g", "t"]).collect()}
    for c in ("g", "t"):
        for r in stats.participants_per_answer(df, "p", c).collect():
            assert multi[(c, r[c])] == r["n_participants"]
    assert len(multi) == 3 + 4
    means = {r["question"]: r["mean"] for r in stats.means_of_distinct(df, "p", ["age", "a"]).collect()}
    assert means["age"] == stats.mean_of_distinct(df, "p", "age").first()[0]
    assert means["a"] == stats.mean_of_distinct(df, "p", "a").first()[0]


def test_answer_tally_of_many_answers_equals_that_of_few(spark):
    df = _df(spark)
    answers = {"n_yes": "yes", "n_no": "no", "n_not_sure": "not sure", "n_na": "NA"}
    few = sorted(map(tuple, stats.answer_tally(df, ["t", "g", "a"], answers).collect()))
    more = answers | {f"n_{i}": f"no such answer {i}" for i in range(100)}
    many = stats.answer_tally(df, ["t", "g", "a"], more).select("question", *answers, "n_total")
    assert sorted(map(tuple, many.collect())) == few


def test_states_of_two_halves_merge_to_the_whole(spark):
    from pyspark.sql import functions as F

    rows = [(f"p{i % 37}" if i % 5 else "hot", ("x", "y", None)[i % 3], str(i % 7), i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "who string, a string, v string, day int")
    parts = [stats.report_state(df.where(c), "who", ["a", "v"], "day") for c in ("day < 2", "day >= 2")]
    state = stats.merge_states(*parts, parts[0])  # a state met twice changes nothing
    want = stats.participants_per_answers(df, "who", ["a", "v"]).collect()
    assert sorted(map(tuple, stats.counts_of_state(state).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert sorted(map(tuple, stats.means_of_state(state).where("question = 'v'").collect())) == sorted(
        map(tuple, stats.means_of_distinct(df, "who", ["v"]).collect()))
    rough = {(r["question"], r["answer"]): r["n_participants"] for r in stats.counts_of_sketches(
        *[stats.sketch_state(df.where(c), "who", ["a", "v"], "day") for c in ("day < 2", "day >= 2")]).collect()}
    exact = {(r["question"], r["answer"]): r[0] for r in df.select(F.col("who"), F.inline(F.array(
        F.struct(F.lit("a").alias("question"), F.col("a").alias("answer")), F.struct(F.lit("v").alias("question"), F.col("v").alias("answer")))))
        .groupBy("question", "answer").agg(F.countDistinct("who").alias("n")).select("n", "question", "answer").collect()}
    assert rough.keys() == exact.keys() and all(abs(rough[k] - n) <= 1 + 0.05 * n for k, n in exact.items())
