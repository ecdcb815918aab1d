"""The questionnaire study as compositions of the generic operators.

``wrangle`` (E1) turns raw long answers into the wide assessment table,
``analysis_table`` (E2) spreads each participant's baseline over their momentary
assessments, ``describe_report`` (E3) returns the descriptive statistics,
``regression_job`` (E4) fits and evaluates the linear model and
``association_report`` (E5) covers the correlation, gamma and OLS analyses.
All return DataFrames (or dicts of them); the caller decides what to act on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import composite_sum, first_non_null, or_missing, products
from ..functions.labels import question_key
from ..operators import association, model, panel, stats
from ..operators.codebook import encode_categories, score_answers
from ..sources.io import col, handover, r_name, safe_names
from . import codebooks as cb

WIDE_KEYS = ["participantUUID", "assessmentNumber", "geotagStart", "geotagEnd"]


def wrangle(answers: DataFrame, min_assessments_exclusive: int = 25, game_id_limit: int = 2000,
            rules=cb.ORDINAL_RULES, order: Sequence[str] = ("TimeAnswered", "ValidatedScore"),
            composites=cb.COMPOSITES, sort: bool = True) -> DataFrame:
    """Raw answers -> wide table, one row per (participant, assessment, geotags).

    Game questions are dropped, answers scored by the code-book, labels cleaned
    and pivoted (earliest answer by ``order`` wins), participants with too few
    assessments removed, and composite scores added.  The columns are the labels
    that remaining participants answered (a bounded distinct list).  The raw
    answers are read once.
    """
    df = panel.drop_out_of_scope(answers, "QuestionId", game_id_limit)
    df = df.withColumn("Q_id_string", question_key("QuestionId", "Question"))
    df = score_answers(df, "QuestionId", "AnswerText", rules, out_col="ValidatedScore")
    # One read of the raw answers: they become cells, from which participants are qualified,
    # the labels (cleaned as the answers are gathered) of the qualified found, and the wide table spread.
    wide = panel.pivot_kept(df, WIDE_KEYS, "Q_id_string", "ValidatedScore", order,
                            "participantUUID", "assessmentNumber", min_assessments_exclusive, clean=True)
    names = wide.columns[len(WIDE_KEYS):]
    missing = sorted({c for items in composites.values() for c in items} - set(names))
    if missing:
        raise ValueError(f"composite items missing from the answers: {missing}")
    wide = wide.withColumns({score: composite_sum(items) for score, items in composites.items()})
    if sort:
        wide = wide.orderBy("participantUUID", "assessmentNumber")
    return wide


def baseline_table(wide: DataFrame, books=cb.BASELINE_BOOKS) -> DataFrame:
    """Baseline rows with encoded confounders, one row per participant (E2, first half)."""
    base = panel.baseline_rows(wide)
    base = panel.select_prefixed(base, WIDE_KEYS + ["baseWellBeingScore", "baseImpulseScore"], "0")
    base = encode_categories(base, books)
    keep = (["participantUUID", "baseWellBeingScore", "baseImpulseScore",
             cb.AGE, cb.GENDER, cb.GREW_UP, cb.YEARS_IN_CITY, cb.EDUCATION, cb.OCCUPATION,
             cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH]
            + [c + "_numeric" for c in books])
    return base.select([col(c) for c in keep])


def momentary_table(wide: DataFrame, books=cb.MOMENTARY_BOOKS) -> DataFrame:
    """Momentary rows with the combined place features, encoded (E2, second half)."""
    mom = panel.momentary_rows(wide)
    mom = panel.select_prefixed(mom, WIDE_KEYS + ["momWellBeingScore", "momImpulseScore"], "1")
    mom = mom.withColumns({
        cb.TREES: first_non_null(cb.TREES_IN, cb.TREES_OUT),
        cb.SKY: or_missing(cb.SKY_IN),
        cb.BIRDS: or_missing(cb.BIRDS_OUT),
        cb.WATER: or_missing(cb.WATER_OUT),
        cb.NATURE: or_missing(cb.NATURE_OUT),
    })
    mom = encode_categories(mom, books)
    return mom.select(
        F.col("participantUUID").alias("momParticipantUUID"),
        F.col("assessmentNumber").alias("momAssessmentNumber"),
        F.col("geotagStart").alias("momGeoTagStart"),
        F.col("geotagEnd").alias("momGeoTagEnd"),
        "momWellBeingScore",
        *[col(c) for c in [cb.INDOORS, cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]],
        *[col(c + "_numeric") for c in books],
    )


def analysis_table(wide: DataFrame, base_books=cb.BASELINE_BOOKS,
                   mom_books=cb.MOMENTARY_BOOKS, salt_buckets: int = 16,
                   broadcast_rows: int | None = 200_000) -> DataFrame:
    """Momentary rows joined with their participant's baseline: 34 columns.

    ``wide`` is read twice, once per half, and column pruning gives the halves
    different plans, so pass a materialised table (:func:`handover`, as
    :func:`run_study` does) rather than the pivot's plan over raw answers.
    The reports aggregate this table by participant.  The baseline (17
    columns) is broadcast when a count shows at most ``broadcast_rows``
    participants; otherwise the join is salted on the assessment key, so a
    participant with most of the rows is spread over ``salt_buckets`` tasks.
    """
    mom = momentary_table(wide, mom_books)
    base = baseline_table(wide, base_books)
    return panel.spread_baseline(mom, base, "momParticipantUUID", "participantUUID",
                                 broadcast_rows=broadcast_rows, salt_buckets=salt_buckets,
                                 salt_by=["momParticipantUUID", "momAssessmentNumber", "momGeoTagStart",
                                          "momGeoTagEnd"])


def describe_report(df: DataFrame, participant: str = "momParticipantUUID") -> dict[str, DataFrame]:
    """Descriptive statistics of the analysis table, each a one-pass aggregate."""
    out: dict[str, DataFrame] = {"participants": stats.participants(df, participant)}
    out["per_answer"] = stats.participants_per_answers(
        df, participant, [cb.GENDER, cb.GREW_UP, cb.OCCUPATION, cb.EDUCATION, cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH])
    out["mean_of_distinct"] = stats.means_of_distinct(df, participant, [cb.AGE, "baseWellBeingScore",
                                                                         "baseImpulseScore"])
    out["mean_momWellBeingScore"] = df.agg(F.avg("momWellBeingScore").alias("mean_momWellBeingScore"))
    out["mean_assessments"] = stats.mean_assessments(df, participant, "momAssessmentNumber")
    out["place_counts"] = stats.count_values(df, cb.INDOORS, {"n_indoors": "Indoors",
                                                             "n_outdoors": "Outdoors", "n_na": "NA"})
    out["answer_tally"] = stats.answer_tally(
        df, [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE],
        {"n_yes": "yes", "n_no": "no", "n_not_sure": "not sure", "n_na": "NA"})
    return out


def with_interactions(df: DataFrame) -> DataFrame:
    """Trait impulsivity times each place feature code (C14); -1 codes multiply in."""
    feats = [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]
    return df.withColumns(products("baseImpulseScore",
                                   {f"impulseInt{i + 1}": f + "_numeric" for i, f in enumerate(feats)}))


def regression_job(df: DataFrame, params: model.RegressionParams = model.RegressionParams(),
                   features: Sequence[str] = cb.REGRESSION_FEATURES,
                   label: str = "momWellBeingScore") -> dict[str, DataFrame]:
    """Fit on a key-hash hold-out split, report coefficients and train/test metrics."""
    prepared = with_interactions(df).where(F.col(label).isNotNull())
    key = F.concat_ws("|", "momParticipantUUID", "momAssessmentNumber", "momGeoTagStart", "momGeoTagEnd")
    train, test = model.holdout_split(prepared, key, params.fracTest, params.seed)
    fitted = model.fit_linear(train, list(features), label, params)
    return {
        "coefficients": model.coefficients(fitted, list(features)),
        "train_metrics": model.regression_metrics(model.predict(fitted, train), label),
        "test_metrics": model.regression_metrics(model.predict(fitted, test), label),
    }


GAMMA_ROWS = ["baseWellBeingScore", cb.GENDER, cb.GREW_UP, cb.EDUCATION, cb.OCCUPATION]
GAMMA_COLUMNS = [*GAMMA_ROWS, cb.INDOORS, cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]


def association_report(df: DataFrame, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Correlations, gamma, OLS with inference and interaction models (E5); with ``only`` just
    the parts of those names."""
    num = df.withColumn(cb.AGE, col(cb.AGE).try_cast("double"))
    r = safe_names(num)
    y = "momWellBeingScore"
    numeric = [c + "_numeric" for c in [cb.GENDER, cb.GREW_UP, cb.EDUCATION, cb.OCCUPATION,
                                        cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH]]
    place = [c + "_numeric" for c in [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]]
    terms = ([r_name(c) for c in ["baseWellBeingScore", cb.AGE] + numeric] + [r_name(cb.INDOORS)]
             + [r_name(c) for c in place])
    covars = [r_name(c) for c in ["baseWellBeingScore", cb.AGE, cb.GENDER + "_numeric",
                                  cb.OCCUPATION + "_numeric"]]
    feats = [r_name(cb.INDOORS)] + [r_name(c) for c in place]
    parts = {
        "pearson": lambda: association.pearson(num, [("baseWellBeingScore", cb.AGE),
                                                     ("baseWellBeingScore", cb.GENDER + "_numeric")],
                                               names=["base_wellbeing_age", "base_wellbeing_gender"]),
        "gamma": lambda: association.gamma_matrix(num, GAMMA_ROWS, GAMMA_COLUMNS),
        "gamma_interval": lambda: association.gamma(num, [(cb.GENDER, cb.OCCUPATION)], level=0.95),
        "describe": lambda: stats.describe(num, [cb.AGE, "baseWellBeingScore", "momWellBeingScore",
                                                 "baseImpulseScore"]),
        "mean_assessments": lambda: stats.mean_assessments(df, "momParticipantUUID", "momAssessmentNumber"),
        "occupations": lambda: stats.distinct_per_participant(df, "momParticipantUUID", cb.OCCUPATION),
        "ols": lambda: model.ols_summary(r, y, terms),
        "interaction_models": lambda: model.interaction_models(r, y, covars, "baseImpulseScore", feats),
    }
    return {name: part() for name, part in parts.items() if only is None or name in only}


def run_study(answers: DataFrame, params: model.RegressionParams = model.RegressionParams(),
              min_assessments_exclusive: int = 25, cut_lineage: bool = True) -> dict[str, object]:
    """E1 -> E2 -> E3/E4/E5 with the wide and analysis tables handed over as tables.

    The hand-over writes each intermediate table once to the shared folder
    (``spark.checkpoint.dir``) so later jobs read it instead of replaying the
    pivot; with ``cut_lineage=False`` the DataFrames are passed on directly.
    """
    wide = wrangle(answers, min_assessments_exclusive, sort=False)
    if cut_lineage:
        wide = handover(wide, "wide_assessments")
    analysis = analysis_table(wide)
    if cut_lineage:
        analysis = handover(analysis, "analysis_table")
    return {
        "wide": wide,
        "analysis": analysis,
        "describe": describe_report(analysis),
        "regression": regression_job(analysis, params),
        "association": association_report(analysis),
    }
