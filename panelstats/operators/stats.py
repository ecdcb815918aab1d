"""Descriptive statistics as one-pass aggregates.

The reference runs one job per number (five per tally); here every operator is
a single aggregate whose result is a small DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def _num(c: str | Column) -> Column:
    return _c(c).try_cast("double")


def participants(df: DataFrame, participant: str, out_col: str = "n_participants",
                 approx_rsd: float | None = None) -> DataFrame:
    """Number of distinct participants.

    Exact by default (distinct ids are shuffled once, after map-side
    de-duplication); with ``approx_rsd`` a HyperLogLog++ sketch of that
    relative error is merged instead, a fixed-size state per task.
    """
    if approx_rsd is not None:
        return df.agg(F.approx_count_distinct(_c(participant), approx_rsd).alias(out_col))
    return df.agg(F.countDistinct(_c(participant)).alias(out_col))


def participants_per_answer(df: DataFrame, participant: str, column: str,
                            out_col: str = "n_participants") -> DataFrame:
    """Distinct participants per answer value of ``column``.

    As in the reference, the null answer forms a group whose count is 0.
    Distinct (participant, answer) is partially aggregated map-side and
    shuffled on both keys, so one participant's rows never meet in one task.
    """
    return (df.select(_c(participant).alias("__p"), _c(column).alias(column)).distinct()
            .groupBy(column).agg(F.count(_c(column)).alias(out_col)))


def participants_per_answers(df: DataFrame, participant: str, columns: Sequence[str],
                             out_col: str = "n_participants") -> DataFrame:
    """:func:`participants_per_answer` for several columns in one pass.

    Each row is unpivoted to (question, answer) pairs inside the scan; one
    distinct and one count then serve every column.  Output: question, answer,
    count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("question"), _c(c).cast("string").alias("answer"))
                      for c in columns])
    long = df.select(_c(participant).alias("__p"), F.inline(pairs))
    return (long.distinct().groupBy("question", "answer")
            .agg(F.count("answer").alias(out_col)))


def means_of_distinct(df: DataFrame, participant: str, columns: Sequence[str]) -> DataFrame:
    """:func:`mean_of_distinct` for several columns in one pass (A8): question, mean."""
    pairs = F.array(*[F.struct(F.lit(c).alias("question"), _num(c).alias("value")) for c in columns])
    long = df.select(_c(participant).alias("__p"), F.inline(pairs))
    return long.distinct().groupBy("question").agg(F.avg("value").alias("mean"))


def mean_of_distinct(df: DataFrame, participant: str, column: str,
                     out_col: str | None = None) -> DataFrame:
    """Mean of ``column`` over distinct (participant, value) pairs.

    A baseline value repeated on every momentary row counts once per participant.
    """
    return (df.select(_c(participant).alias("__p"), _num(column).alias("__v")).distinct()
            .agg(F.avg("__v").alias(out_col or f"mean_{column}")))


def mean_assessments(df: DataFrame, participant: str, assessment: str,
                     out_col: str = "mean_assessments") -> DataFrame:
    """Mean number of distinct assessments per participant."""
    return (df.groupBy(_c(participant)).agg(F.countDistinct(_c(assessment)).alias("__n"))
            .agg(F.avg("__n").alias(out_col)))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean and sample standard deviation of several columns in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count(_num(c)).alias(f"n_{c}"), F.avg(_num(c)).alias(f"mean_{c}"),
                 F.stddev_samp(_num(c)).alias(f"sd_{c}")]
    return df.agg(*aggs)


def count_values(df: DataFrame, column: str, values: Mapping[str, object]) -> DataFrame:
    """Conditional counts ``name -> count(column == value)`` in one pass (A12); compared as text."""
    return df.agg(*[F.count_if(_c(column).cast("string") == F.lit(str(v))).alias(n) for n, v in values.items()])


def answer_tally(df: DataFrame, columns: Sequence[str], answers: Mapping[str, object],
                 total_col: str = "n_total") -> DataFrame:
    """Per question column: how many rows hold each listed answer, and all rows.

    Answers are compared as text, so one answer list serves columns of any type.

    One pass: each row is unpivoted to (question, answer) inside the scan and
    grouped by question, so the aggregate stays narrow however many columns are
    asked for.  A table without rows gives no rows.
    """
    # one array needs one element type: answers are compared as text
    pairs = F.array(*[F.struct(F.lit(c).alias("question"), _c(c).cast("string").alias("__a"))
                      for c in columns])
    long = df.select(F.inline(pairs))
    return long.groupBy("question").agg(
        *[F.count_if(F.col("__a") == F.lit(str(v))).alias(n) for n, v in answers.items()],
        F.count(F.lit(1)).alias(total_col))


def distinct_per_participant(df: DataFrame, participant: str, column: str,
                             out_col: str | None = None) -> DataFrame:
    """Distinct answers of ``column`` per participant."""
    return df.groupBy(_c(participant)).agg(F.countDistinct(_c(column)).alias(out_col or f"n_{column}"))


# -- states that merge -------------------------------------------------------

def report_state(df: DataFrame, participant: str, columns: Sequence[str], period: str | Column) -> DataFrame:
    """The exact state of the per-answer and mean-of-distinct reports (A6-A8), per period:
    distinct (period, question, participant, answer).

    Much smaller than the answers, since a participant's baseline value counts once a period
    however many assessments repeat it.  States of later answers are appended
    (:func:`merge_states`), and the reports are read from states alone, so old answers are
    never scanned again.  Shuffled on all four columns after map-side reduction.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("question"), _c(c).cast("string").alias("answer")) for c in columns])
    return df.select(_c(period).alias("period"), _c(participant).alias("participant"), F.inline(pairs)).distinct()


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several, of the same or of different periods."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.distinct() if len(states) > 1 else out


def counts_of_state(state: DataFrame, out_col: str = "n_participants") -> DataFrame:
    """:func:`participants_per_answers` from a state: question, answer, count."""
    return (state.select("question", "participant", "answer").distinct()
            .groupBy("question", "answer").agg(F.count("answer").alias(out_col)))


def means_of_state(state: DataFrame) -> DataFrame:
    """:func:`means_of_distinct` from a state: question, mean."""
    return (state.select("question", "participant", _num("answer").alias("value")).distinct()
            .groupBy("question").agg(F.avg("value").alias("mean")))


def sketch_state(df: DataFrame, participant: str, columns: Sequence[str], period: str | Column, digits: int = 12) -> DataFrame:
    """(period, question, answer, sketch): a distinct-count sketch of 2^``digits`` registers of the
    participants per answer.  A few kilobytes a row whatever the number of participants; the
    relative standard error is 1.04 / sqrt(2^digits), 1.6 % at 12."""
    pairs = F.array(*[F.struct(F.lit(c).alias("question"), _c(c).cast("string").alias("answer")) for c in columns])
    long = df.select(_c(period).alias("period"), _c(participant).cast("string").alias("participant"), F.inline(pairs))
    return long.groupBy("period", "question", "answer").agg(F.hll_sketch_agg("participant", F.lit(digits)).alias("sketch"))


def counts_of_sketches(*states: DataFrame, out_col: str = "n_participants") -> DataFrame:
    """Estimated participants per question and answer over all periods of the states."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return both.groupBy("question", "answer").agg(estimate.alias(out_col))
