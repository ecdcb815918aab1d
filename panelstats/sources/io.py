"""Scans, sinks and table-level helpers.

Everything returns a DataFrame and runs no action, except the writers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def check_unique_names(names: Iterable[str]) -> None:
    """Reject duplicate column names (case-insensitive, as Spark resolves them)."""
    counts = Counter(n.lower() for n in names)
    dups = sorted(n for n, c in counts.items() if c > 1)
    if dups:
        raise ValueError(f"duplicate column names in schema: {dups}")


def declared_schema(fields: Sequence[tuple[str, str]] | T.StructType) -> T.StructType:
    """Build a ``StructType`` from ``(name, type)`` pairs and reject duplicates."""
    if isinstance(fields, T.StructType):
        schema = fields
    else:
        schema = T.StructType(
            [T.StructField(n, _TYPES[t.lower()] if isinstance(t, str) else t, True)
             for n, t in fields]
        )
    check_unique_names(schema.fieldNames())
    return schema


# Long answers table of a questionnaire study: one row per answered question.
ANSWERS_SCHEMA = declared_schema([
    ("participantUUID", "string"),
    ("assessmentNumber", "int"),
    ("geotagStart", "string"),
    ("geotagEnd", "string"),
    ("QuestionId", "int"),
    ("Question", "string"),
    ("AnswerText", "string"),
    ("AnswerValue", "string"),
    ("TimeAnswered", "timestamp"),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan with a header (S1); a declared schema avoids the inference pass.

    A missing file raises ``AnalysisException`` at once.  Caching is the
    caller's decision: a cached scan blocks filter pushdown.
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(declared_schema(schema))
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


#: Column of a checked scan that holds the text of a line that does not fit the schema.
REJECTED_LINE = "__rejected_line"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a CSV scan in which every line is accounted for.

    A line with a value that does not parse as its column's type, or with too few or too
    many fields, is rejected whole: its text is in the second table (column ``line``), and
    nothing of it is in the first.  Every line but headers and blank ones is in exactly one
    of them.  The file is parsed once, into a stored table that both results read; Spark
    would otherwise prune the columns it need not parse and with them the errors.
    """
    schema = declared_schema(schema)
    whole = T.StructType([*schema.fields, T.StructField(REJECTED_LINE, T.StringType())])
    parsed = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
              .option("columnNameOfCorruptRecord", REJECTED_LINE).schema(whole).csv(path))
    stored = handover(parsed, "checked_scan")
    bad = F.col(REJECTED_LINE).isNotNull()
    return stored.where(~bad).drop(REJECTED_LINE), stored.where(bad).select(F.col(REJECTED_LINE).alias("line"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True,
                single_file: bool = False, mode: str = "overwrite") -> str:
    """Write a table (S3/S4).  ``single_file`` funnels through one task: small outputs only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header)
    writer.save(path)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Read back a table written by :func:`write_table`."""
    if fmt == "csv":
        return read_csv(spark, path, schema=schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def handover(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the cluster's shared folder and read it back.

    Cuts the lineage between jobs: after a lost executor Spark rereads the
    table instead of recomputing the plan that produced it.
    """
    from ..session import shared_dir

    spark = df.sparkSession
    path = write_table(df, shared_dir(spark, name))
    return spark.read.parquet(path)


def rows(spark: SparkSession, data: Sequence[Sequence], schema: T.StructType | str | Sequence[str]) -> DataFrame:
    """In-memory literal rows (S5): code-books and small fixtures."""
    return spark.createDataFrame(list(data), schema)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a temporary SQL view."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, query: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL with named parameters (``:name``) and DataFrames as ``{name}``."""
    return spark.sql(query, args=args, **frames)


# R's rule for syntactic names: letters, digits, '.' and '_'; a leading digit,
# underscore or '.digit' gets an 'X' in front.
_R_INVALID = re.compile(r"[^A-Za-z0-9._]")
_R_VALID_START = re.compile(r"^([A-Za-z]|\.(?![0-9]))")


def r_name(name: str) -> str:
    """One column name as R's ``make.names`` spells it (``002_Gender`` -> ``X002_Gender``)."""
    out = _R_INVALID.sub(".", name)
    if not _R_VALID_START.match(out):
        out = "X" + out
    return out


def safe_names(df: DataFrame) -> DataFrame:
    """Rename every column as R's ``read.csv`` would (S7), de-duplicating with ``.1``, ``.2``."""
    names: list[str] = []
    for c in df.columns:
        base = n = r_name(c)
        k = 0
        while n in names:  # a numbered name may itself be taken
            k += 1
            n = f"{base}.{k}"
        names.append(n)
    return df.toDF(*names)


def col(name: str) -> Column:
    """A column reference that tolerates blanks, dots and quotes in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_rows(df: DataFrame, n: int, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows (S8, T4); with ``order_by`` a top-k, not an arbitrary sample."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """Row and column count in one row (A5)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"))
