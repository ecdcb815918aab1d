"""The study's association query gives every part of the report that study_models does not."""

from panelstats.plans import questionnaire as q
from panelstats.plans import study


def test_study_gamma_gives_the_interval_and_the_other_parts(spark, monkeypatch):
    asked = []
    real = q.association_report
    monkeypatch.setattr(q, "association_report", lambda df, only=None: asked.append(only) or real(df, only))
    rows = study.study_gamma(spark, "/root/testdata/sf0.001").collect()
    study.study_models(spark, "/root/testdata/sf0.001")
    assert {r["part"] for r in rows} == {"gamma", "gamma_interval", "pearson", "describe", "mean_assessments", "occupations"}
    interval, = [r for r in rows if r["part"] == "gamma_interval"]
    same, = [r for r in rows if r["part"] == "gamma" and (r["x"], r["y"]) == (interval["x"], interval["y"])]
    assert interval["gamma"] == same["gamma"] and interval["lower"] < interval["gamma"] < interval["upper"] and interval["ase"] > 0
    assert sum(r["part"] == "gamma" for r in rows) == len(q.GAMMA_ROWS) * len(q.GAMMA_COLUMNS)
    # together the two queries run the whole report
    assert sorted(n for only in asked for n in only) == sorted(["pearson", "gamma", "gamma_interval", "describe", "mean_assessments",
                                                                "occupations", "ols", "interaction_models"])


def test_answers_are_the_ones_the_sql_derives(spark):
    """Answers of one order and one customer: places, the answer given twice, the one left out."""
    df = study.answers(spark, "/root/testdata/sf0.001")
    assert df.columns == ["participantUUID", "assessmentNumber", "geotagStart", "geotagEnd", "QuestionId", "Question", "AnswerText",
                          "AnswerValue", "TimeAnswered"]
    twice = df.where("QuestionId = 132").groupBy("participantUUID", "assessmentNumber").agg({"TimeAnswered": "count"}).collect()
    assert {r[2] for r in twice} == {2}
    assert df.where("QuestionId >= 2000").count() == len(twice)
