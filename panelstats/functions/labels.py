"""Question labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters removed from labels and the pattern of a clean label.
LABEL_REMOVE = "[',?:.]"
CLEAN_LABEL_PATTERN = "^[a-zA-Z0-9][^'?,:.]*$"


def _c(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def pad_id(c: str | Column, width: int = 3) -> Column:
    """Zero-pad an integer to at least ``width`` digits; never truncates; null stays null."""
    c = _c(c)
    text = c.cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    # formatting a row costs several times as much; only a minus sign needs it
    return F.when(c >= 0, padded).otherwise(F.when(c.isNotNull(), F.format_string(f"%0{width}d", c)))


def question_key(id_col: str | Column, text_col: str | Column, width: int = 3) -> Column:
    """``<padded id>_<question text>``; null when either part is null."""
    return F.concat(pad_id(id_col, width), F.lit("_"), _c(text_col))


def clean_label(c: str | Column) -> Column:
    """Remove ``' ? , : .`` from a label so it can be a column name."""
    c = _c(c)
    for mark in LABEL_REMOVE[1:-1]:  # searches for one text cost less than a pattern
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def is_clean_label(c: str | Column) -> Column:
    """True when the label starts alphanumeric and holds none of the removed characters (C4)."""
    return _c(c).rlike(CLEAN_LABEL_PATTERN)


def label_quality(df: DataFrame, c: str) -> DataFrame:
    """Data-quality count: labels, clean labels, and labels clean after :func:`clean_label`."""
    return df.agg(
        F.count(_c(c)).alias("n_labels"),
        F.count_if(is_clean_label(c)).alias("n_clean"),
        F.count_if(is_clean_label(clean_label(c))).alias("n_clean_after"),
    )


def distinct_labels(df: DataFrame, c: str | Column) -> DataFrame:
    """Distinct labels (P12); partial aggregation before the shuffle.  A null label (no id or no
    text) names no column and is left out."""
    return df.select(_c(c).alias("label")).where(F.col("label").isNotNull()).distinct()


def sorted_labels(df: DataFrame, c: str | Column, max_values: int | None = None) -> list[str]:
    """Distinct labels in binary order on the driver.

    This is pivot-value discovery: the result becomes a column list, so it is
    bounded by ``spark.sql.pivotMaxValues`` and refused above it.
    """
    spark = df.sparkSession
    cap = max_values or int(spark.conf.get("spark.sql.pivotMaxValues", "10000"))
    got = [r[0] for r in distinct_labels(df, c).limit(cap + 1).collect()]
    if len(got) > cap:
        raise ValueError(f"more than {cap} distinct labels: not a column list")
    return sorted(got, key=lambda s: s.encode("utf-8"))
