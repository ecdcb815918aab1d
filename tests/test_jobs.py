"""End-to-end: the study's jobs on the hand-built answers (tests/fixtures.py)."""

import pytest
from pyspark.sql import functions as F

from panelstats.plans import codebooks as cb
from panelstats.plans import questionnaire as q
from panelstats.sources.io import col
from tests.fixtures import answer_rows, answers_frame


@pytest.fixture(scope="module")
def wide(spark):
    return q.wrangle(answers_frame(spark)).persist()


@pytest.fixture(scope="module")
def analysis(spark, wide):
    return q.analysis_table(wide).persist()


def test_wrangle_drops_games_and_short_participants(wide):
    ids = {r[0] for r in wide.select("participantUUID").distinct().collect()}
    assert ids == {"P1_1", "P2_2", "P4_4"} | {f"P{i}_{i}" for i in range(6, 14)}  # not P3_3 (25), P5_5
    assert not any(c.startswith("2001") for c in wide.columns)


def test_wide_rows_equal_groups_and_labels_clean(spark, wide):
    raw = answers_frame(spark).where(F.col("QuestionId") < 2000)
    kept = raw.where(~F.col("participantUUID").isin("P3_3", "P5_5"))
    assert wide.count() == kept.select(*q.WIDE_KEYS).distinct().count()
    labels = wide.columns[4:-4]
    assert labels == sorted(labels)
    import re

    assert all(re.match(r"^[a-zA-Z0-9][^'?,:.]*$", c) for c in labels)


def test_composites(spark, wide):
    rows = answer_rows()
    p1 = {r[6] for r in rows if r[0] == "P1_1" and r[1] == 0 and r[4] in range(41, 55)}
    assert p1  # answered
    base = wide.where("participantUUID = 'P1_1' AND assessmentNumber = 0").first()
    items = [base[c] for c in cb.BASE_WELLBEING_ITEMS]
    assert base["baseWellBeingScore"] == sum(float(i) for i in items)
    # P2_2 skipped one wellbeing item at assessment 3: composite is null.
    r = wide.where("participantUUID = 'P2_2' AND assessmentNumber = 3").first()
    assert r["momWellBeingScore"] is None
    r = wide.where("participantUUID = 'P2_2' AND assessmentNumber = 4").first()
    assert 14 <= r["momWellBeingScore"] <= 70 and 9 <= r["momImpulseScore"] <= 45


def test_drinks_scored_with_mangled_dates(wide):
    vals = {r[0] for r in wide.select(col("028_How many drinks")).collect()}
    assert vals <= {"0", "05-Jun", None}


def test_analysis_table_shape_and_rules(analysis):
    assert len(analysis.columns) == 34
    ids = {r[0] for r in analysis.select("momParticipantUUID").distinct().collect()}
    assert ids == {"P1_1", "P2_2"} | {f"P{i}_{i}" for i in range(6, 14)}  # P4_4 lacks a baseline
    rows = analysis.collect()
    n_mom = 26 + 25 + sum(25 + i % 3 for i in range(6, 14))
    assert len(rows) == n_mom
    for r in rows:
        tin = r[cb.TREES]
        assert r[cb.TREES + "_numeric"] == {"yes": 1, "no": 0, "not sure": 0}.get(tin, -1)
        if r[cb.INDOORS] == "Indoors":
            assert r[cb.BIRDS] == "NA" and r[cb.BIRDS + "_numeric"] == -1
        else:
            assert r[cb.SKY] == "NA"
        assert r[cb.GENDER + "_numeric"] == cb.BASELINE_BOOKS[cb.GENDER].get(r[cb.GENDER], -1)


def test_indoor_answer_wins(spark):
    from panelstats.functions.columns import first_non_null

    df = spark.createDataFrame([("no", "yes"), (None, None)], [cb.TREES_IN, cb.TREES_OUT])
    out = df.select(first_non_null(cb.TREES_IN, cb.TREES_OUT).alias(cb.TREES))
    from panelstats.operators.codebook import encode_categories

    got = [tuple(r) for r in encode_categories(out, {cb.TREES: cb.MOMENTARY_BOOKS[cb.TREES]}).collect()]
    assert got == [("no", 0), (None, -1)]


def test_describe_report(analysis):
    rep = q.describe_report(analysis)
    assert rep["participants"].first()[0] == 10
    tally = {r["question"]: r for r in rep["answer_tally"].collect()}
    for r in tally.values():
        assert r["n_yes"] + r["n_no"] + r["n_not_sure"] + r["n_na"] <= r["n_total"] == analysis.count()
    pc = rep["place_counts"].first()
    assert pc["n_indoors"] + pc["n_outdoors"] == analysis.count()
    n = analysis.count()
    assert abs(rep["mean_assessments"].first()[0] - n / 10) < 1e-12


def test_regression_job(analysis):
    out = q.regression_job(analysis)
    coefs = out["coefficients"].collect()
    assert len(coefs) == len(cb.REGRESSION_FEATURES) + 1
    assert out["test_metrics"].first()["n"] > 0


def test_association_report(analysis):
    rep = q.association_report(analysis)
    assert rep["gamma"].count() == 5 * 11
    assert rep["pearson"].first()["n_base_wellbeing_age"] == analysis.where("baseWellBeingScore IS NOT NULL").count()
    assert rep["ols"].count() > 3
    models = {r["model"] for r in rep["interaction_models"].collect()}
    assert len(models) == 6


def test_run_study_with_handover(spark):
    out = q.run_study(answers_frame(spark))
    assert len(out["analysis"].columns) == 34
    assert out["analysis"].count() == 26 + 25 + sum(25 + i % 3 for i in range(6, 14))
    assert out["describe"]["participants"].first()[0] == 10
    assert out["regression"]["coefficients"].count() == len(cb.REGRESSION_FEATURES) + 1


def test_sql_lookups_on_scored_answers(spark):
    """The reference's own checks: one answer looked up through SQL on a view."""
    from panelstats.functions.labels import clean_label, question_key
    from panelstats.operators.codebook import score_answers
    from panelstats.sources.io import register_view, run_sql

    rows = answer_rows()
    df = answers_frame(spark).withColumn("Q_id_string", question_key("QuestionId", "Question"))
    df = score_answers(df, "QuestionId", "AnswerText", cb.ORDINAL_RULES)
    register_view(df, "answers")
    p, a = "P1_1", 0
    gender = next(r[6] for r in rows if r[0] == p and r[1] == a and r[4] == 2)
    got = run_sql(spark, "SELECT ValidatedScore, Q_id_string FROM answers WHERE participantUUID = :p "
                         "AND assessmentNumber = :a AND QuestionId = 2", args={"p": p, "a": a}).collect()
    assert [(r[0], r[1]) for r in got] == [(gender, "002_Gender.")]
    age = next(r for r in rows if r[0] == p and r[1] == a and r[4] == 1)
    got = run_sql(spark, "SELECT AnswerValue FROM answers WHERE participantUUID = :p AND QuestionId = 1",
                  args={"p": p}).first()
    assert got[0] == age[7] == age[6]
    # 110-style check: distinct question keys, games included, match the raw rows
    n_keys = df.select(clean_label("Q_id_string")).distinct().count()
    assert n_keys == len({(r[4], r[5]) for r in rows})


def test_run_study_analysis_reads_the_handed_over_table(spark):
    out = q.run_study(answers_frame(spark))
    plan = out["analysis"]._jdf.queryExecution().executedPlan().toString()
    # the analysis table is itself handed over: its plan is a plain parquet scan
    assert "FileScan parquet" in plan and "Join" not in plan and "Aggregate" not in plan


def test_wide_columns_are_labels_answered_by_kept_participants(wide):
    import re

    rows = answer_rows()
    per = {}
    for r in rows:
        if r[4] is not None and r[4] < 2000:
            per.setdefault(r[0], set()).add(r[1])
    kept = {p for p, a in per.items() if len(a) > 25}

    def label(qid, text):
        return re.sub(r"[',?:.]", "", f"{qid:03d}_{text}")

    want = sorted({label(r[4], r[5]) for r in rows if r[0] in kept and r[4] < 2000}, key=lambda s: s.encode())
    assert wide.columns[4:-4] == want
