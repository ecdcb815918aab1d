"""Streaming use of the row-level operators.

The study has no streaming operator of its own (no windows, watermarks or
state).  What carries over is that every row-level step -- game filter,
question keys, label cleaning, code-book scoring (a stream-static join) and
categorical encoding -- is a plain DataFrame transformation, so the same
functions apply unchanged to a streaming DataFrame from ``readStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.labels import clean_label, question_key
from ..operators.codebook import score_answers
from ..operators.panel import drop_out_of_scope
from ..plans.codebooks import ORDINAL_RULES
from ..sources.io import ANSWERS_SCHEMA


def scored_answers(answers: DataFrame, rules=ORDINAL_RULES, game_id_limit: int = 2000) -> DataFrame:
    """Raw answers -> scored answers with clean question keys; batch or streaming."""
    df = drop_out_of_scope(answers, "QuestionId", game_id_limit)
    df = df.withColumn("Q_id_string_cleaned", clean_label(question_key("QuestionId", "Question")))
    return score_answers(df, "QuestionId", "AnswerText", rules, out_col="ValidatedScore")


def read_answer_stream(spark: SparkSession, path: str, fmt: str = "csv",
                       schema: T.StructType = ANSWERS_SCHEMA) -> DataFrame:
    """A streaming DataFrame over answer files arriving in ``path`` (declared schema)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)
