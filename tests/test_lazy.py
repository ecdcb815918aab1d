"""Operators build plans only: no Spark job runs until the caller acts (quirk Q12)."""

from panelstats.functions.columns import composite_sum
from panelstats.operators import association, codebook, panel, stats
from panelstats.plans import codebooks as cb
from panelstats.plans import questionnaire as q
from tests.fixtures import answers_frame


def _jobs(spark, group):
    return spark.sparkContext.statusTracker().getJobIdsForGroup(group)


def test_operators_run_no_jobs(spark):
    answers = answers_frame(spark)
    sc = spark.sparkContext
    sc.setJobGroup("lazy-check", "operators must not act")
    try:
        df = panel.drop_out_of_scope(answers, "QuestionId", 2000)
        df = codebook.score_answers(df, "QuestionId", "AnswerText", cb.ORDINAL_RULES)
        w = panel.pivot_first(df, q.WIDE_KEYS, "QuestionId", "ValidatedScore", ["TimeAnswered"], ["1", "2"])
        w = panel.qualify_assessments(w)
        w = w.withColumn("s", composite_sum(["1", "2"]))
        panel.keep_participants(df)
        stats.answer_tally(df, ["AnswerText"], {"n_yes": "yes"})
        stats.participants_per_answer(df, "participantUUID", "AnswerText")
        association.contingency(df, [("QuestionId", "AnswerText")])  # gamma itself stores and counts the cells
        codebook.encode_categories(df, {"AnswerText": cb.BASELINE_BOOKS[cb.GENDER]})
        assert _jobs(spark, "lazy-check") == []
    finally:
        sc.setJobGroup("after-lazy-check", "")
