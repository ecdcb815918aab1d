"""Registered queries: every operator run on the driver's tables, with its SQL twin.

Analogy used throughout (the study's own data is private):

* ``events`` are answers: participant ``user_id``, assessment ``to_date(ts)``,
  question ``event_type``, answer ``value`` (or ``props`` for text), total
  order ``(ts, event_id)`` for "earliest answer wins".
* ``customer`` is the baseline (one row per participant), ``orders`` the
  momentary assessments (many per participant).
* ``lineitem`` holds coded answers: question id ``l_linenumber``, answer
  ``l_returnflag`` / ``l_linestatus``.

Every query reads whole tables.  Each ``QUERIES[name]`` takes
``(spark, sf_dir)`` and returns a DataFrame; ``ORACLE_SQL[name]``, where
present, is the same result in plain SQL over the same tables.  Floating-point
results are rounded identically on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import composite_sum, first_non_null, or_missing, products, sparse_columns, value_or_text
from ..functions.labels import clean_label, label_quality, question_key, sorted_labels
from ..operators import association, model, panel, stats
from ..operators.codebook import OrdinalRule, encode_categories, id_range, score_answers
from ..session import shared_dir
from ..sources.io import (
    col, declared_schema, first_rows, handover, profile, read_csv, read_csv_checked, run_sql, safe_names, write_table)

# The event types of the driver's tables, for the columns of the SQL twins; the queries discover theirs.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as long answers: (user_id, day, event_type, value, props, ts, event_id)."""
    return table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type", "value", "props", "ts", "event_id")


def wide(spark: SparkSession, sf_dir: str, value: str = "value", values=None) -> DataFrame:
    """One row per (user, day), one column per event type found: earliest answer wins."""
    return panel.pivot_first(answers(spark, sf_dir), ["user_id", "day"], "event_type", value, ORDER, values)


def _sql_wide(value: str = "value", values=EVENT_TYPES) -> str:
    cols = ",\n    ".join(
        f"arg_min_null({value}, (ts, event_id)) FILTER (WHERE event_type = '{v}') AS {v}" for v in values)
    return f"SELECT user_id, CAST(ts AS DATE) AS day,\n    {cols}\n  FROM events GROUP BY 1, 2"


def _md5_hash_sql(key: str, seed: int = 123) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Flagship: qualify participants, pivot, composite score (E1 on events)
# ---------------------------------------------------------------------------

@register("wide_scores", f"""
WITH w AS ({_sql_wide()}),
k AS (SELECT user_id FROM w GROUP BY user_id HAVING count(DISTINCT day) > 25)
SELECT w.*, w.click + w.view AS click_view_score
FROM w WHERE user_id IN (SELECT user_id FROM k)
ORDER BY user_id, day
""")
def wide_scores(spark, sf_dir):
    """Users with > 25 distinct days, wide by event type, composite."""
    # The events are read once, for the cells; qualification, labels and the wide table read those.
    w = panel.pivot_kept(answers(spark, sf_dir), ["user_id", "day"], "event_type", "value", ORDER, "user_id", "day",
                         min_exclusive=25, labels_of_kept=False)
    w = w.select("*", composite_sum(["click", "view"]).alias("click_view_score"))
    return w.orderBy("user_id", "day")


@register("kept_answers", """
WITH k AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS totalAssessments FROM events
           GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) > 25)
SELECT e.event_id, e.user_id, e.event_type, e.value, k.totalAssessments
FROM events e JOIN k ON e.user_id = k.user_id
""")
def kept_answers(spark, sf_dir):
    """Raw answers of qualifying participants, carrying their assessment count.

    Join form on the long table: the kept ids (one row per participant) are
    counted and broadcast when at most a million, so raw answers are not
    shuffled by participant.
    """
    a = answers(spark, sf_dir).select("event_id", "user_id", "day", "event_type", "value")
    kept = panel.keep_participants(a, "user_id", "day", min_exclusive=25, with_count=True,
                                   broadcast_rows=1_000_000)
    return kept.select("event_id", "user_id", "event_type", "value", "totalAssessments")


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

CUSTOMER_SCHEMA = declared_schema([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                                   ("c_acctbal", "double"), ("c_mktsegment", "string")])


@register("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Write CSV with header to the shared folder, read back with a declared schema."""
    path = shared_dir(spark, "csv_roundtrip")
    write_table(table(spark, sf_dir, "customer").select(*CUSTOMER_SCHEMA.fieldNames()), path, fmt="csv")
    return read_csv(spark, path, schema=CUSTOMER_SCHEMA)


@register("csv_inferred", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def csv_inferred(spark, sf_dir):
    """The same file read with inferred column types (whole numbers become int)."""
    path = shared_dir(spark, "csv_inferred")
    write_table(table(spark, sf_dir, "customer").select(*CUSTOMER_SCHEMA.fieldNames()), path, fmt="csv")
    return read_csv(spark, path)


_BAD_LINE = "CASE WHEN o_orderkey % 50 = 3 THEN 'price' WHEN o_orderkey % 70 = 4 THEN 'short' WHEN o_orderkey % 90 = 5 THEN 'long' END"


@register("csv_malformed", f"""
WITH o AS (SELECT *, {_BAD_LINE} AS fault FROM orders)
SELECT count(*) AS n_lines, count(*) FILTER (WHERE fault IS NULL) AS n_rows, count(fault) AS n_rejected,
       sum(o_custkey) FILTER (WHERE fault IS NULL) AS custkeys, count(*) FILTER (WHERE fault = 'price') AS n_rejected_for_price
FROM o""")
def csv_malformed(spark, sf_dir):
    """A CSV file with unparsable, short and long lines; every line is a row or a rejected line."""
    o = table(spark, sf_dir, "orders").withColumn("fault", F.expr(_BAD_LINE))
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("fault") == "price", "unknown").otherwise(F.col("o_totalprice").cast("string")),
                       F.when(F.col("fault").isNull() | (F.col("fault") != "short"), F.col("o_orderstatus")), F.when(F.col("fault") == "long", "more"))
    path = shared_dir(spark, "csv_malformed")
    o.select(line.alias("value")).write.text(path)
    schema = declared_schema([("key", "bigint"), ("custkey", "bigint"), ("price", "double"), ("status", "string")])
    good, rejected = read_csv_checked(spark, path, schema, header=False)
    a = good.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("custkey").alias("custkeys"))
    b = rejected.agg(F.count("line").alias("n_rejected"), F.count_if(F.col("line").contains("unknown")).alias("n_rejected_for_price"))
    both = a.join(F.broadcast(b), F.lit(True))  # one row each
    return both.select((F.col("n_rows") + F.col("n_rejected")).alias("n_lines"), "n_rows", "n_rejected", "custkeys", "n_rejected_for_price")


@register("parquet_handover", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def parquet_handover(spark, sf_dir):
    """A table handed over through the shared folder as parquet."""
    return handover(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"),
                    "parquet_handover")


@register("sql_view_lookup", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, value FROM events
WHERE user_id = 7 AND CAST(ts AS DATE) = DATE '2024-01-16' AND event_type = 'click'
""")
def sql_view_lookup(spark, sf_dir):
    """Conjunctive equality lookup of one answer through SQL with named parameters."""
    return run_sql(spark, """
        SELECT event_id, user_id, to_date(ts) AS day, event_type, value FROM {events}
        WHERE user_id = :user AND to_date(ts) = :day AND event_type = :question""",
                   args={"user": 7, "day": dt.date(2024, 1, 16), "question": "click"},
                   events=table(spark, sf_dir, "events"))


@register("safe_names", """
SELECT c_custkey AS "X001_Customer.key", c_mktsegment AS "X002_Market.segment",
       c_acctbal AS "X003_Account.balance..USD." FROM customer
""")
def safe_names_query(spark, sf_dir):
    """Question-label column names renamed as R reads them, then a subset."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("001_Customer key"), F.col("c_name").alias("004_Name"),
        F.col("c_mktsegment").alias("002_Market segment"), F.col("c_acctbal").alias("003_Account balance (USD)"))
    r = safe_names(c)
    return r.select(*[col(c) for c in ["X001_Customer.key", "X002_Market.segment", "X003_Account.balance..USD."]])


@register("first_rows", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 20
""")
def first_rows_query(spark, sf_dir):
    """First 20 rows under a total multi-key ascending order (top-k)."""
    o = table(spark, sf_dir, "orders")
    return first_rows(o, 20, ["o_custkey", "o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@register("table_profile", """
SELECT count(*) AS n_rows, CAST(any_value(c.n) AS INTEGER) AS n_cols
FROM lineitem, (SELECT count(*) AS n FROM (DESCRIBE lineitem)) c""")
def table_profile(spark, sf_dir):
    """A5: row and column count."""
    return profile(table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------------------
# Projections, filters, labels
# ---------------------------------------------------------------------------

_LINE_KEEP = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


@register("drop_out_of_scope", f"SELECT {', '.join(_LINE_KEEP)} FROM lineitem WHERE l_linenumber < 6")
def drop_out_of_scope(spark, sf_dir):
    """Drop ids at or above the limit (games), drop unused columns."""
    li = panel.drop_out_of_scope(table(spark, sf_dir, "lineitem"), "l_linenumber", 6)
    return li.drop("l_tax", "l_shipdate")


@register("question_keys", """
SELECT DISTINCT regexp_replace(printf('%03d', p_size) || '_' || p_type || ', ' || p_brand || '?',
                               '[''?,:.]', '', 'g') AS question_key
FROM part
""")
def question_keys(spark, sf_dir):
    """Padded id + text, cleaned, distinct."""
    p = table(spark, sf_dir, "part")
    text = F.concat("p_type", F.lit(", "), "p_brand", F.lit("?"))
    return p.select(clean_label(question_key("p_size", text)).alias("question_key")).distinct()


@register("label_check", """
SELECT count(url) AS n_labels,
       count(*) FILTER (WHERE regexp_matches(url, '^[a-zA-Z0-9][^''?,:.]*$')) AS n_clean,
       count(*) FILTER (WHERE regexp_matches(regexp_replace(url, '[''?,:.]', '', 'g'),
                                             '^[a-zA-Z0-9][^''?,:.]*$')) AS n_clean_after
FROM pages
""")
def label_check(spark, sf_dir):
    """C4 C17: how many labels are clean before and after cleaning."""
    return label_quality(table(spark, sf_dir, "pages"), "url")


# ---------------------------------------------------------------------------
# Code-books
# ---------------------------------------------------------------------------

# Demonstration book over lineitem: question id = line number, answer = return flag.
LINE_RULES = [
    OrdinalRule(id_range(1, 3), "A", "1"),
    OrdinalRule(id_range(1, 3), "N", "2"),
    OrdinalRule(id_range(1, 3), "R", "3"),
    OrdinalRule(id_range(4, 5), "A", "3"),
    OrdinalRule(id_range(4, 5), "N", "2"),
    OrdinalRule((6,), "R", "0"),
]
_LINE_CASE = """CASE
    WHEN l_linenumber IS NULL THEN NULL
    WHEN l_linenumber BETWEEN 1 AND 3 AND l_returnflag = 'A' THEN {a}
    WHEN l_linenumber BETWEEN 1 AND 3 AND l_returnflag = 'N' THEN {b}
    WHEN l_linenumber BETWEEN 1 AND 3 AND l_returnflag = 'R' THEN {c}
    WHEN l_linenumber BETWEEN 4 AND 5 AND l_returnflag = 'A' THEN {c}
    WHEN l_linenumber BETWEEN 4 AND 5 AND l_returnflag = 'N' THEN {b}
    WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN {z}
    ELSE {default} END"""


@register("ordinal_scores", "SELECT l_orderkey, l_linenumber, l_returnflag, "
          + _LINE_CASE.format(a="'1'", b="'2'", c="'3'", z="'0'", default="l_returnflag")
          + " AS score FROM lineitem")
def ordinal_scores(spark, sf_dir):
    """Range code-book as a broadcast join; unmatched keeps the text."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return score_answers(li, "l_linenumber", "l_returnflag", LINE_RULES, out_col="score")


@register("ordinal_scores_default", "SELECT l_orderkey, l_linenumber, l_returnflag, "
          + _LINE_CASE.format(a="1", b="2", c="3", z="0", default="-1")
          + " AS score FROM lineitem")
def ordinal_scores_default(spark, sf_dir):
    """The same book with integer scores and -1 for unmatched."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return score_answers(li, "l_linenumber", "l_returnflag", LINE_RULES, out_col="score",
                         default=-1, score_type=T.IntegerType())


SEGMENT_BOOK = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3}
SEGMENT_BOOK_OLD = {"BUILDING": 0, "FURNITURE": 1, "HOUSEHOLD": 2, "MACHINERY": 3}
STATUS_BOOK = {"F": 1, "O": 0, "P": 0}
PRIORITY_BOOK = {"1-URGENT": 1, "5-LOW": 0}


@register("category_codes", """
SELECT c_custkey, c_mktsegment,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                    WHEN 'HOUSEHOLD' THEN 3 ELSE -1 END AS c_mktsegment_numeric,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'HOUSEHOLD' THEN 2
                    WHEN 'MACHINERY' THEN 3 ELSE -1 END AS c_mktsegment_numeric_old
FROM customer
""")
def category_codes(spark, sf_dir):
    """One column under two code-books, unmatched -1, one projection."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    c = encode_categories(c, {"c_mktsegment": SEGMENT_BOOK})
    return encode_categories(c, {"c_mktsegment": SEGMENT_BOOK_OLD}, suffix="_numeric_old")


@register("category_codes_momentary", """
SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 ELSE -1 END AS o_orderstatus_numeric,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 ELSE -1 END AS o_orderpriority_numeric
FROM orders
""")
def category_codes_momentary(spark, sf_dir):
    """Two columns encoded in one projection."""
    o = table(spark, sf_dir, "orders")
    o = encode_categories(o, {"o_orderstatus": STATUS_BOOK, "o_orderpriority": PRIORITY_BOOK})
    return o.select("o_orderkey", "o_orderstatus_numeric", "o_orderpriority_numeric")


# ---------------------------------------------------------------------------
# Row-wise columns
# ---------------------------------------------------------------------------

@register("combined_features", f"""
WITH w AS ({_sql_wide('props')})
SELECT user_id, day, coalesce(click, view) AS click_or_view,
       coalesce(purchase, 'NA') AS purchase_or_na, coalesce(signup, 'NA') AS signup_or_na
FROM w
""")
def combined_features(spark, sf_dir):
    """First non-null of two pivoted answers; "NA" where a question does not apply."""
    w = wide(spark, sf_dir, value="props")
    return w.select("user_id", "day", first_non_null("click", "view").alias("click_or_view"),
                    or_missing("purchase").alias("purchase_or_na"), or_missing("signup").alias("signup_or_na"))


@register("value_or_text", """
SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '4-NOT') THEN o_orderstatus
                        ELSE o_orderpriority END AS answer
FROM orders
""")
def value_or_text_query(spark, sf_dir):
    """The value unless it is marked "no value", then the text."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", value_or_text("o_orderpriority", "o_orderstatus", "4-NOT").alias("answer"))


@register("sparse_columns", "SELECT event_id, user_id, "
          + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in EVENT_TYPES)
          + " FROM events")
def sparse_columns_query(spark, sf_dir):
    """One column per question, the answer where the row's question matches."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", *sparse_columns("event_type", "value", sorted_labels(e, "event_type")))


@register("answered_only", f"WITH w AS ({_sql_wide()}) SELECT * FROM w WHERE purchase IS NOT NULL")
def answered_only(spark, sf_dir):
    """Assessments where a given question was answered."""
    return panel.answered(wide(spark, sf_dir), "purchase")


# ---------------------------------------------------------------------------
# Baseline / momentary split and spread
# ---------------------------------------------------------------------------

def numbered_orders(spark, sf_dir) -> DataFrame:
    """Orders as assessments: a customer's earliest order (by date, key) is number 0,
    later ones the days since it plus one.  Columns carry the study's prefixes:
    ``0..`` baseline questions, ``1..`` momentary questions.
    """
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"),
        F.min("o_orderdate").alias("first_date"))
    o = o.join(first, "o_custkey")
    number = F.when(F.col("o_orderkey") == F.col("first_key"), F.lit(0)).otherwise(
        F.datediff(F.to_date("o_orderdate"), F.to_date("first_date")) + 1)
    return o.select("o_custkey", number.alias("assessmentNumber"), "o_orderkey",
                    F.col("o_orderpriority").alias("01_priority"), F.col("o_totalprice").alias("02_totalprice"),
                    F.col("o_orderstatus").alias("11_status"), F.col("o_totalprice").alias("12_totalprice"))


_SQL_NUMBERED = """WITH f AS (
  SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, min(o_orderdate) AS first_date
  FROM orders GROUP BY 1),
n AS (
  SELECT o.o_custkey,
         CASE WHEN o.o_orderkey = f.first_key THEN 0
              ELSE CAST(date_diff('day', CAST(f.first_date AS DATE), CAST(o.o_orderdate AS DATE)) AS INTEGER) + 1
         END AS assessmentNumber,
         o.o_orderkey, o.o_orderpriority AS "01_priority", o.o_totalprice AS "02_totalprice",
         o.o_orderstatus AS "11_status", o.o_totalprice AS "12_totalprice"
  FROM orders o JOIN f ON o.o_custkey = f.o_custkey)"""


@register("baseline_rows", _SQL_NUMBERED + """
SELECT o_custkey, assessmentNumber, o_orderkey, "01_priority", "02_totalprice" FROM n WHERE assessmentNumber = 0""")
def baseline_rows(spark, sf_dir):
    """Assessment 0, fixed columns plus every column starting with 0."""
    n = panel.baseline_rows(numbered_orders(spark, sf_dir))
    return panel.select_prefixed(n, ["o_custkey", "assessmentNumber", "o_orderkey"], "0")


@register("momentary_rows", _SQL_NUMBERED + """
SELECT o_custkey, assessmentNumber, o_orderkey, "11_status", "12_totalprice" FROM n WHERE assessmentNumber > 0""")
def momentary_rows(spark, sf_dir):
    """Assessments above 0, fixed columns plus every column starting with 1."""
    n = panel.momentary_rows(numbered_orders(spark, sf_dir))
    return panel.select_prefixed(n, ["o_custkey", "assessmentNumber", "o_orderkey"], "1")


def _mom_base(spark, sf_dir) -> DataFrame:
    mom = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("momParticipantKey"), F.col("o_orderkey").alias("momAssessmentKey"),
        F.col("o_totalprice").alias("momTotalPrice"), "o_orderstatus", "o_orderpriority")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    # Aggregates by participant follow in several queries.  Broadcast the
    # baseline when a count proves it small (four narrow columns, at most a
    # million rows); otherwise salt the join on the order key so one customer
    # with many orders is spread over tasks.
    return panel.spread_baseline(mom, base, "momParticipantKey", "c_custkey", broadcast_rows=1_000_000,
                                 salt_buckets=8, salt_by=["momAssessmentKey"])


_SQL_MOM_BASE = """SELECT o.o_custkey AS momParticipantKey, o.o_orderkey AS momAssessmentKey,
       o.o_totalprice AS momTotalPrice, o.o_orderstatus, o.o_orderpriority,
       c.c_custkey, c.c_acctbal, c.c_mktsegment, c.c_nationkey
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


@register("baseline_join", _SQL_MOM_BASE)
def baseline_join(spark, sf_dir):
    """Momentary rows (renamed) with their participant's baseline columns."""
    return _mom_base(spark, sf_dir)


@register("interactions", f"""
WITH j AS ({_SQL_MOM_BASE}),
c AS (SELECT momAssessmentKey, c_acctbal,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 ELSE -1 END AS status_code,
        CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 ELSE -1 END AS priority_code
      FROM j)
SELECT momAssessmentKey, c_acctbal, status_code, priority_code,
       c_acctbal * status_code AS int_status, c_acctbal * priority_code AS int_priority FROM c
""")
def interactions(spark, sf_dir):
    """C14: baseline value times encoded momentary features (-1 codes multiply in)."""
    j = encode_categories(_mom_base(spark, sf_dir), {"o_orderstatus": STATUS_BOOK, "o_orderpriority": PRIORITY_BOOK},
                          names={"o_orderstatus": "status_code", "o_orderpriority": "priority_code"})
    j = j.withColumns(products("c_acctbal", {"int_status": "status_code", "int_priority": "priority_code"}))
    return j.select("momAssessmentKey", "c_acctbal", "status_code", "priority_code", "int_status", "int_priority")


# ---------------------------------------------------------------------------
# Pivots
# ---------------------------------------------------------------------------

_PIVOT_LIST = ["click", "refund", "view"]


@register("pivot_values", _sql_wide(values=_PIVOT_LIST))
def pivot_values(spark, sf_dir):
    """A3: pivot with a given value list; "refund" never occurs and gives an all-null column."""
    return wide(spark, sf_dir, values=_PIVOT_LIST)


_WIDE_LABELS = sorted(f"{t}_{i}" for t in EVENT_TYPES for i in range(22))


@register("pivot_wide", "SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(
    f"arg_min_null(value, (ts, event_id)) FILTER (WHERE event_type || '_' || (event_id % 22) = '{v}') AS {v}"
    for v in _WIDE_LABELS) + " FROM events GROUP BY 1, 2")
def pivot_wide(spark, sf_dir):
    """Pivot with 110 discovered labels (event type and a question number)."""
    a = answers(spark, sf_dir)
    a = a.withColumn("label", F.concat("event_type", F.lit("_"), F.col("event_id") % 22))
    return panel.pivot_first(a, ["user_id", "day"], "label", "value", ORDER)


@register("pivot_max", """
SELECT l_returnflag, max(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "F",
       max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def pivot_max(spark, sf_dir):
    """A4: pivot with max where the grouping column is also the pivot column, then dropped."""
    li = table(spark, sf_dir, "lineitem")
    p = panel.pivot_agg(li, ["l_returnflag", "l_linestatus"], "l_linestatus", ["F", "O"], F.max("l_quantity"))
    return p.orderBy("l_linestatus").drop("l_linestatus")


@register("pivot_groups", "SELECT count(*) AS n_groups FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events)")
def pivot_groups(spark, sf_dir):
    """Distinct (participant, assessment) groups = rows of the pivot."""
    return panel.distinct_groups(answers(spark, sf_dir), ["user_id", "day"])


# ---------------------------------------------------------------------------
# Descriptive statistics
# ---------------------------------------------------------------------------

@register("participants", "SELECT count(DISTINCT user_id) AS n_participants FROM events")
def participants(spark, sf_dir):
    """A6."""
    return stats.participants(table(spark, sf_dir, "events"), "user_id")


@register("participants_per_answer", f"""
SELECT c_mktsegment, count(c_mktsegment) AS n_participants
FROM (SELECT DISTINCT momParticipantKey, c_mktsegment FROM ({_SQL_MOM_BASE}))
GROUP BY c_mktsegment
""")
def participants_per_answer(spark, sf_dir):
    """Distinct participants per baseline answer on the joined table."""
    return stats.participants_per_answer(_mom_base(spark, sf_dir), "momParticipantKey", "c_mktsegment")


_PPA_COLS = ["c_mktsegment", "o_orderstatus", "o_orderpriority"]


@register("participants_per_answers", f"WITH j AS ({_SQL_MOM_BASE}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS question, answer, count(answer) AS n_participants FROM "
    f"(SELECT DISTINCT momParticipantKey, CAST({c} AS VARCHAR) AS answer FROM j) GROUP BY answer"
    for c in _PPA_COLS))
def participants_per_answers(spark, sf_dir):
    """A7 for several columns in one pass over the joined table."""
    return stats.participants_per_answers(_mom_base(spark, sf_dir), "momParticipantKey", _PPA_COLS)


@register("mean_of_distinct", f"""
SELECT round(avg(c_acctbal), 4) AS mean_c_acctbal
FROM (SELECT DISTINCT momParticipantKey, c_acctbal FROM ({_SQL_MOM_BASE}))
""")
def mean_of_distinct(spark, sf_dir):
    """A baseline value repeated on every momentary row counts once per participant."""
    m = stats.mean_of_distinct(_mom_base(spark, sf_dir), "momParticipantKey", "c_acctbal")
    return m.select(F.round("mean_c_acctbal", 4).alias("mean_c_acctbal"))


_MOD_COLS = ["c_acctbal", "c_nationkey"]


@register("means_of_distinct", f"WITH j AS ({_SQL_MOM_BASE}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS question, round(avg(v), 4) AS mean FROM "
    f"(SELECT DISTINCT momParticipantKey, CAST({c} AS DOUBLE) AS v FROM j)" for c in _MOD_COLS))
def means_of_distinct(spark, sf_dir):
    """A8 for several columns in one pass over the joined table."""
    m = stats.means_of_distinct(_mom_base(spark, sf_dir), "momParticipantKey", _MOD_COLS)
    return m.select("question", F.round("mean", 4).alias("mean"))


@register("mean_assessments", """
SELECT round(avg(n), 4) AS mean_assessments
FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id)
""")
def mean_assessments(spark, sf_dir):
    """Mean distinct assessments per participant."""
    m = stats.mean_assessments(answers(spark, sf_dir), "user_id", "day")
    return m.select(F.round("mean_assessments", 4).alias("mean_assessments"))


_STATE_COLS = ["event_type", "props"]
_HALVES = ["day < DATE '2024-01-16'", "day >= DATE '2024-01-16'"]


def _state_halves(spark, sf_dir, state) -> list[DataFrame]:
    """States of the events before and from a day on, each stored by itself with the month as its period."""
    a = answers(spark, sf_dir)
    return [handover(state(a.where(half), "user_id", _STATE_COLS, F.date_trunc("month", "ts")), "state") for half in _HALVES]


@register("merged_state_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS question, CAST({c} AS VARCHAR) AS answer, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN user_id END) AS n_participants "
    f"FROM events GROUP BY {c}" for c in _STATE_COLS))
def merged_state_counts(spark, sf_dir):
    """Participants per answer from two merged states, without the events."""
    return stats.counts_of_state(stats.merge_states(*_state_halves(spark, sf_dir, stats.report_state)))


@register("merged_sketch_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS question, CAST({c} AS VARCHAR) AS answer, count(DISTINCT user_id) AS n_participants, true AS within_error "
    f"FROM events GROUP BY {c}" for c in _STATE_COLS))
def merged_sketch_counts(spark, sf_dir):
    """The same from merged sketches, held against the exact counts: within four standard errors."""
    rough = stats.counts_of_sketches(*_state_halves(spark, sf_dir, stats.sketch_state), out_col="estimate")
    exact = stats.participants_per_answers(answers(spark, sf_dir), "user_id", _STATE_COLS)
    error = F.abs(F.col("estimate") - F.col("n_participants")) <= F.ceil(4 * 1.04 / 64 * F.col("n_participants"))
    same = (rough["question"] == exact["question"]) & rough["answer"].eqNullSafe(exact["answer"])
    return rough.join(exact, same).select(exact["question"], exact["answer"], "n_participants", error.alias("within_error"))


_DESCRIBE = ["l_quantity", "l_extendedprice", "l_discount"]


@register("describe", "SELECT " + ", ".join(
    f"count({c}) AS n_{c}, round(avg({c}), 4) AS mean_{c}, round(stddev_samp({c}), 4) AS sd_{c}"
    for c in _DESCRIBE) + " FROM lineitem")
def describe(spark, sf_dir):
    """Count, mean and sample sd of several columns in one pass."""
    d = stats.describe(table(spark, sf_dir, "lineitem"), _DESCRIBE)
    return d.select(*[F.round(c, 4).alias(c) if not c.startswith("n_") else F.col(c) for c in d.columns])


@register("place_counts", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P FROM orders
""")
def place_counts(spark, sf_dir):
    """Conditional counts in one pass."""
    return stats.count_values(table(spark, sf_dir, "orders"), "o_orderstatus", {"n_F": "F", "n_O": "O", "n_P": "P"})


_TALLY = {"n_A": "A", "n_F": "F", "n_N": "N", "n_O": "O", "n_R": "R"}


@register("answer_tally", " UNION ALL ".join(
    f"SELECT '{c}' AS question, "
    + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {n}" for n, v in _TALLY.items())
    + ", count(*) AS n_total FROM lineitem" for c in ["l_returnflag", "l_linestatus"]))
def answer_tally(spark, sf_dir):
    """Per question column, the count of each listed answer and all rows, one scan."""
    return stats.answer_tally(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _TALLY)


@register("answers_per_participant", """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_custkey
""")
def answers_per_participant(spark, sf_dir):
    """Distinct answers per participant."""
    return stats.distinct_per_participant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority",
                                          "n_priorities")


# ---------------------------------------------------------------------------
# Association
# ---------------------------------------------------------------------------

@register("pearson", """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS r_qty_price,
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS n_qty_price,
       round(corr(l_discount, l_tax), 6) AS r_disc_tax,
       count(*) FILTER (WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) AS n_disc_tax
FROM lineitem
""")
def pearson(spark, sf_dir):
    """B1: several Pearson correlations in one pass, with the number of rows used."""
    r = association.pearson(table(spark, sf_dir, "lineitem"),
                            [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")],
                            names=["qty_price", "disc_tax"])
    return r.select(F.round("r_qty_price", 6).alias("r_qty_price"), "n_qty_price",
                    F.round("r_disc_tax", 6).alias("r_disc_tax"), "n_disc_tax")


def _sql_gamma(x: str, y: str, src: str, with_interval: bool = False) -> str:
    cells = (f"SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {src} "
             f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2")
    if not with_interval:
        return f"""(WITH t AS ({cells}),
p AS (SELECT coalesce(sum(CASE WHEN a.y < b.y THEN a.n * b.n END), 0) AS c,
             coalesce(sum(CASE WHEN a.y > b.y THEN a.n * b.n END), 0) AS d
      FROM t a JOIN t b ON a.x < b.x)
SELECT '{x}' AS x, '{y}' AS y, (SELECT sum(n) FROM t) AS n_obs, c AS n_concordant, d AS n_discordant,
       round((c - d) / (c + d), 6) AS gamma FROM p)"""
    return f"""WITH t AS ({cells}),
m AS (SELECT a.x, a.y, a.n,
        coalesce(sum(CASE WHEN (b.x > a.x AND b.y > a.y) OR (b.x < a.x AND b.y < a.y) THEN b.n END), 0) AS ca,
        coalesce(sum(CASE WHEN (b.x > a.x AND b.y < a.y) OR (b.x < a.x AND b.y > a.y) THEN b.n END), 0) AS da
      FROM t a LEFT JOIN t b ON a.x <> b.x AND a.y <> b.y GROUP BY a.x, a.y, a.n),
s AS (SELECT sum(n * ca) AS P, sum(n * da) AS Q, sum(n) AS n_obs FROM m),
e AS (SELECT P, Q, n_obs, (P - Q) / (P + Q) AS g,
             4.0 / ((P + Q) * (P + Q)) * sqrt(sum(m.n * (Q * m.ca - P * m.da) * (Q * m.ca - P * m.da))) AS ase
      FROM m, s GROUP BY P, Q, n_obs)
SELECT '{x}' AS x, '{y}' AS y, n_obs, P / 2 AS n_concordant, Q / 2 AS n_discordant, round(g, 6) AS gamma,
       round(ase, 6) AS ase, round(g - 1.959963984540054 * ase, 6) AS lower,
       round(g + 1.959963984540054 * ase, 6) AS upper FROM e"""


def _round_gamma(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("gamma", "ase", "lower", "upper") else F.col(c)
                       for c in df.columns])


@register("gamma_pair", "SELECT * FROM " + _sql_gamma("o_orderstatus", "o_orderpriority", "orders"))
def gamma_pair(spark, sf_dir):
    """B2: Goodman-Kruskal gamma of two ordinal columns."""
    g = association.gamma(table(spark, sf_dir, "orders"), [("o_orderstatus", "o_orderpriority")], level=None)
    return _round_gamma(g)


_GM_ROWS = ["o_orderstatus", "o_orderpriority"]
_GM_COLS = ["c_mktsegment", "c_nationkey"]


@register("gamma_matrix", f"WITH j AS ({_SQL_MOM_BASE}) " + " UNION ALL ".join(
    "SELECT * FROM " + _sql_gamma(x, y, "j") for x in _GM_ROWS for y in _GM_COLS))
def gamma_matrix(spark, sf_dir):
    """Gamma for every (row column, column column) pair from one scan of the joined table."""
    g = association.gamma_matrix(_mom_base(spark, sf_dir), _GM_ROWS, _GM_COLS, level=None)
    return _round_gamma(g)


@register("gamma_interval", _sql_gamma("o_orderstatus", "o_orderpriority", "orders", with_interval=True))
def gamma_interval(spark, sf_dir):
    """Gamma with asymptotic standard error and 95% interval."""
    g = association.gamma(table(spark, sf_dir, "orders"), [("o_orderstatus", "o_orderpriority")], level=0.95)
    return _round_gamma(g)


_BEFORE, _AFTER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


@register("gamma_many_values", f"""
WITH t AS (SELECT l_extendedprice AS x, l_quantity AS y, count(*)::DOUBLE AS n FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2),
g AS (SELECT x, y, coalesce(n, 0) AS n FROM (SELECT DISTINCT x FROM t) CROSS JOIN (SELECT DISTINCT y FROM t) LEFT JOIN t USING (x, y)),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY x ORDER BY y {_BEFORE}), 0) AS lo,
             coalesce(sum(n) OVER (PARTITION BY x ORDER BY y {_AFTER}), 0) AS hi FROM g),
m AS (SELECT n, coalesce(sum(lo) OVER (PARTITION BY y ORDER BY x {_BEFORE}), 0) + coalesce(sum(hi) OVER (PARTITION BY y ORDER BY x {_AFTER}), 0) AS a,
             coalesce(sum(hi) OVER (PARTITION BY y ORDER BY x {_BEFORE}), 0) + coalesce(sum(lo) OVER (PARTITION BY y ORDER BY x {_AFTER}), 0) AS d FROM r),
s AS (SELECT sum(n * a) AS P, sum(n * d) AS Q, sum(n) AS n_obs FROM m WHERE n > 0),
e AS (SELECT P, Q, n_obs, (P - Q) / (P + Q) AS g, 4.0 / ((P + Q) * (P + Q)) * sqrt(sum(n * pow(Q * a - P * d, 2))) AS ase
      FROM m, s WHERE n > 0 GROUP BY P, Q, n_obs)
SELECT 'l_extendedprice' AS x, 'l_quantity' AS y, n_obs, P / 2 AS n_concordant, Q / 2 AS n_discordant, round(g, 6) AS gamma,
       round(ase, 6) AS ase, round(g - 1.959963984540054 * ase, 6) AS lower, round(g + 1.959963984540054 * ase, 6) AS upper FROM e""")
def gamma_many_values(spark, sf_dir):
    """Gamma of a column with nearly as many values as rows, by distributed dominance counts."""
    return _round_gamma(association.gamma(table(spark, sf_dir, "lineitem"), [("l_extendedprice", "l_quantity")]))


# ---------------------------------------------------------------------------
# Models
# ---------------------------------------------------------------------------

@register("holdout_split", f"""
SELECT o_orderkey, CASE WHEN {_md5_hash_sql('o_orderkey')} < 2147483648 THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def holdout_split(spark, sf_dir):
    """M4 M9: 50/50 split on the key hash, seed 123."""
    o = table(spark, sf_dir, "orders")
    params = model.RegressionParams(fracTest=0.5, seed=123)
    b = model.split_hash("o_orderkey", params.seed)
    cut = model.first_hash_of_test(params.fracTest)
    return o.select("o_orderkey", F.when(b < cut, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def _md5_order_sql(key: str, seed: int = 123) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15))::BIGINT"


@register("exact_holdout", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_md5_order_sql('o_orderkey')}) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i <= n - round_even(n * 0.3, 0) THEN 'train' ELSE 'test' END AS split FROM r""")
def exact_holdout(spark, sf_dir):
    """M4 M9: exactly round(0.3 n) rows held out, the border found by histograms of the key's hash."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    train, test = model.exact_holdout(o, "o_orderkey", 0.3)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@register("participant_holdout", f"""
WITH u AS (SELECT user_id, row_number() OVER (ORDER BY {_md5_order_sql('user_id')}) AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT user_id FROM events))
SELECT e.user_id, CASE WHEN any_value(i) <= any_value(n) - round_even(any_value(n) * 0.25, 0) THEN 'train' ELSE 'test' END AS split,
       count(*) AS n_answers FROM events e JOIN u USING (user_id) GROUP BY e.user_id""")
def participant_holdout(spark, sf_dir):
    """M4 M9: a quarter of the participants held out with all their answers; the sides share none."""
    train, test = model.exact_holdout(table(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", 0.25, by="user_id")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("n_answers"))


@register("ols_two", """
WITH s AS (SELECT covar_samp(l_quantity, l_extendedprice) AS sy1, covar_samp(l_discount, l_extendedprice) AS sy2,
                  var_samp(l_quantity) AS s11, var_samp(l_discount) AS s22,
                  covar_samp(l_quantity, l_discount) AS s12,
                  avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
b AS (SELECT (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1,
             (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM s)
SELECT 'l_quantity' AS term, round(b1, 3) AS estimate FROM b
UNION ALL SELECT 'l_discount', round(b2, 3) FROM b
UNION ALL SELECT '(Intercept)', round(my - b1 * m1 - b2 * m2, 3) FROM b
""")
def ols_two(spark, sf_dir):
    """M1 M2 M3: assemble, fit a linear regression pipeline, report coefficients."""
    li = table(spark, sf_dir, "lineitem")
    feats = ["l_quantity", "l_discount"]
    fitted = model.fit_linear(li, feats, "l_extendedprice", model.RegressionParams(solver="normal"))
    c = model.coefficients(fitted, feats)
    return c.select("term", F.round("estimate", 3).alias("estimate"))


@register("predict_rmse", f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, {_md5_hash_sql('l_orderkey')} AS b FROM lineitem),
m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM d WHERE b < 2147483648),
e AS (SELECT y - (m.i + m.s * x) AS err, y FROM d, m WHERE b >= 2147483648)
SELECT count(*) AS n, round(sqrt(avg(err * err)), 4) AS rmse, round(avg(err * err), 0) AS mse,
       round(avg(abs(err)), 4) AS mae, round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2 FROM e
""")
def predict_rmse(spark, sf_dir):
    """M5 M6: fit on the train half, score the test half, all metrics in one pass."""
    li = table(spark, sf_dir, "lineitem")
    # Fit and evaluation read the data several times: project and bucket once.
    data = model.fit_input(li.withColumn("b", model.split_hash("l_orderkey", 123)),
                           ["l_quantity", "l_extendedprice", "b"])
    train, test = data.where("b < 2147483648"), data.where("b >= 2147483648")
    fitted = model.fit_linear(train, ["l_quantity"], "l_extendedprice", model.RegressionParams(solver="normal"))
    m = model.regression_metrics(model.predict(fitted, test), "l_extendedprice")
    row = m.select("n", F.round("rmse", 4).alias("rmse"), F.round("mse", 0).alias("mse"),
                   F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2")).first()
    data.unpersist()
    return spark.createDataFrame([row], "n long, rmse double, mse double, mae double, r2 double")


def _model_table(spark, sf_dir) -> DataFrame:
    j = encode_categories(_mom_base(spark, sf_dir), {"o_orderstatus": STATUS_BOOK, "o_orderpriority": PRIORITY_BOOK},
                          names={"o_orderstatus": "status_code", "o_orderpriority": "priority_code"})
    return j.withColumn("c_nationkey", F.col("c_nationkey").cast("double"))


@register("cv_ols", f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, {_md5_hash_sql('l_orderkey')} % 3 AS fold FROM lineitem),
m AS (SELECT f.fold, regr_slope(d.y, d.x) AS s, regr_intercept(d.y, d.x) AS i
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
e AS (SELECT d.fold, sqrt(avg((d.y - (m.i + m.s * d.x)) * (d.y - (m.i + m.s * d.x)))) AS rmse
      FROM d JOIN m ON d.fold = m.fold GROUP BY d.fold)
SELECT round(avg(rmse), 4) AS avg_rmse FROM e
""")
def cv_ols(spark, sf_dir):
    """M8: 3-fold cross-validated RMSE of an OLS fit, folds by key hash (closed form per fold)."""
    li = table(spark, sf_dir, "lineitem")
    res, _ = model.cross_validate(li, ["l_quantity"], "l_extendedprice", key="l_orderkey", grid_maps=[{}],
                                  params=model.RegressionParams(solver="normal"), folds=3)
    return res.select(F.round("avg_rmse", 4).alias("avg_rmse"))


_GRID_FEATURES = ["c_acctbal", "status_code", "priority_code"]
_SQL_CODED = f"""WITH RECURSIVE j AS ({_SQL_MOM_BASE}),
k AS (SELECT momAssessmentKey, momTotalPrice, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, o_orderstatus, o_orderpriority,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 ELSE -1 END AS status_code,
        CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 ELSE -1 END AS priority_code FROM j)"""


def _sql_grid(maps: list[tuple[float, float, bool]], sweeps: int = 40, folds: int = 3) -> str:
    """CTEs ending in ``scored``: mean held-out RMSE of every (regParam, elasticNetParam,
    standardization) by coordinate descent on three features, folds by key hash."""
    pairs = [(1, 2), (1, 3), (2, 3)]
    soft = lambda z, i: (f"sign({z}) * greatest(abs({z}) - l1 * w{i}, 0) / (1 + l2 * w{i} * w{i})")
    rows = ", ".join(f"({i}, {r!r}::DOUBLE, {e!r}::DOUBLE, {s})" for i, (r, e, s) in enumerate(maps))
    return _SQL_CODED + f""",
d AS (SELECT c_acctbal AS x1, status_code AS x2, priority_code AS x3, momTotalPrice AS y,
             {_md5_hash_sql('momAssessmentKey')} % {folds} AS fold FROM k),
maps(id, reg, enet, scaled) AS (VALUES {rows}),
t AS (SELECT f.fold, avg(y) AS my, sqrt(var_pop(y)) AS sy, {", ".join(f"avg(x{i}) AS m{i}, sqrt(var_pop(x{i})) AS s{i}, covar_pop(x{i}, y) / sqrt(var_pop(x{i}) * var_pop(y)) AS c{i}" for i in (1, 2, 3))},
             {", ".join(f"covar_pop(x{i}, x{j}) / sqrt(var_pop(x{i}) * var_pop(x{j})) AS r{i}{j}" for i, j in pairs)}
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
p AS (SELECT *, reg * enet / sy AS l1, reg * (1 - enet) / sy AS l2,
             {", ".join(f"CASE WHEN scaled THEN 1 ELSE 1 / s{i} END AS w{i}" for i in (1, 2, 3))} FROM t, maps),
cd(fold, id, sweep, v1, v2, v3) AS (
  SELECT fold, id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM p
  UNION ALL
  SELECT fold, id, sweep + 1, n1, n2, {soft("(c3 - r13 * n1 - r23 * n2)", 3)} FROM
    (SELECT *, {soft("(c2 - r12 * n1 - r23 * v3)", 2)} AS n2 FROM
      (SELECT p.*, sweep, v2, v3, {soft("(c1 - r12 * v2 - r13 * v3)", 1)} AS n1
       FROM cd JOIN p USING (fold, id) WHERE sweep < {sweeps}))),
w AS (SELECT p.*, v1 * sy / s1 AS b1, v2 * sy / s2 AS b2, v3 * sy / s3 AS b3 FROM cd JOIN p USING (fold, id) WHERE sweep = {sweeps}),
e AS (SELECT id, fold, sqrt(avg(pow(y - my - b1 * (x1 - m1) - b2 * (x2 - m2) - b3 * (x3 - m3), 2))) AS rmse
      FROM d JOIN w USING (fold) GROUP BY id, fold),
scored AS (SELECT id, reg, enet, scaled, avg(rmse) AS rmse FROM e JOIN maps USING (id) GROUP BY ALL)"""


def _grid(spark, sf_dir, reg: tuple[float, float]):
    """(estimator, scores per map, best map) of a grid of two strengths, ridge and elastic net, scaled or not."""
    params = model.RegressionParams(regParam=reg[0], maxIter=20, tol=0.0)
    lr = model.linear_regression("momTotalPrice", params)
    maps = model.param_grid(lr, params, reg=reg[1:], iters=(), enet=(0.5,), tols=())
    return lr, *model.cross_validate(_model_table(spark, sf_dir), _GRID_FEATURES, "momTotalPrice",
                                     key="momAssessmentKey", grid_maps=maps, params=params, folds=3)


_GRID_MAPS = [(r, e, s) for r in (0.0, 200.0) for e in (0.0, 0.5) for s in ("false", "true")]


@register("grid_cv", _sql_grid(_GRID_MAPS) + """
SELECT reg AS regParam, 20 AS maxIter, enet AS elasticNetParam, scaled AS standardization, 0.0::DOUBLE AS tol,
       round(rmse, 4) AS avg_rmse FROM scored""")
def grid_cv(spark, sf_dir):
    """M7 M8: 3-fold cross-validation over a grid of ridge and elastic-net maps, from one scan."""
    _, res, _ = _grid(spark, sf_dir, (0.0, 200.0))
    return res.withColumn("avg_rmse", F.round("avg_rmse", 4))


_BEST_MAPS = [(r, e, s) for r in (100.0, 300.0) for e in (0.0, 0.5) for s in ("false", "true")]


@register("best_params", _sql_grid(_BEST_MAPS) + """,
best AS (SELECT * FROM scored ORDER BY rmse, id LIMIT 1)
SELECT 'regParam' AS name, CAST(reg AS VARCHAR) AS value FROM best
UNION ALL SELECT 'elasticNetParam', CAST(enet AS VARCHAR) FROM best
UNION ALL SELECT 'standardization', CAST(scaled AS VARCHAR) FROM best
UNION ALL SELECT 'maxIter', '20' FROM best""")
def best_params(spark, sf_dir):
    """The parameters of the best map of a grid, as the estimator describes them."""
    lr, _, best = _grid(spark, sf_dir, (100.0, 300.0))
    lr.setParams(**{n: best[n] for n in ("regParam", "elasticNetParam", "standardization", "maxIter")})
    told = model.explain_params(lr).where(F.col("name").isin("regParam", "elasticNetParam", "standardization", "maxIter"))
    return told.select("name", F.lower("value").alias("value"))


def _sql_model(model_name: str, src: str, y: str, columns: dict[str, str], tag: str) -> tuple[str, str]:
    """(CTEs, SELECT) of an OLS model with inference: central moments, then one sweep per column.
    p values by Simpson's rule on the t density."""
    k = len(columns)
    n = range(1, k + 2)
    z = {i: e for i, e in enumerate([*columns.values(), y], 1)}
    ctes = [f"{tag}d AS (SELECT * FROM (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS z{i}' for i, e in z.items())} FROM {src}) WHERE "
            + " AND ".join(f"z{i} IS NOT NULL" for i in n) + ")",
            f"{tag}m AS (SELECT count(*) AS n, {', '.join(f'avg(z{i}) AS m{i}' for i in n)}, "
            + ", ".join(f"covar_pop(z{i}, z{j}) * count(*) AS s{i}_{j}" for i in n for j in n if i <= j) + f" FROM {tag}d)",
            f"{tag}s0 AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, s{min(i, j)}_{max(i, j)} AS v FROM {tag}m" for i in n for j in n) + ")"]
    for q in range(1, k + 1):
        ctes.append(f"""{tag}s{q} AS (SELECT a.i, a.j, CASE WHEN a.i = {q} AND a.j = {q} THEN 1 / p.v WHEN a.i = {q} THEN a.v / p.v
  WHEN a.j = {q} THEN -a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v FROM {tag}s{q - 1} a
  JOIN {tag}s{q - 1} p ON p.i = {q} AND p.j = {q} JOIN {tag}s{q - 1} r ON r.i = a.i AND r.j = {q} JOIN {tag}s{q - 1} c ON c.i = {q} AND c.j = a.j)""")
    last = f"{tag}s{k}"
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(columns, 1))
    means = "CASE {0} " + " ".join(f"WHEN {i} THEN m{i}" for i in range(1, k + 1)) + " END"
    ctes += [
        f"{tag}e AS (SELECT i, v AS est FROM {last} WHERE j = {k + 1} AND i <= {k})",
        f"{tag}g AS (SELECT n - {k} - 1 AS free, (SELECT v FROM {last} WHERE i = {k + 1} AND j = {k + 1}) AS sse, s{k + 1}_{k + 1} AS spread, m.* FROM {tag}m m)",
        f"{tag}names(i, term) AS (VALUES {names}, ({k + 1}, '(Intercept)'))",
        f"""{tag}f AS (SELECT e.i, est, sqrt(sse / free * x.v) AS se FROM {tag}e e JOIN {last} x ON x.i = e.i AND x.j = e.i, {tag}g
  UNION ALL SELECT {k + 1}, m{k + 1} - (SELECT sum(est * {means.format('i')}) FROM {tag}e),
    sqrt(sse / free * (1.0 / n + (SELECT sum(v * {means.format('i')} * {means.format('j')}) FROM {last} WHERE i <= {k} AND j <= {k}))) FROM {tag}g)""",
        f"{tag}t AS (SELECT f.*, est / se AS t, free, 1 - sse / spread AS r2, n, least(abs(est / se), 40) / 2000 AS h FROM {tag}f f, {tag}g)",
        f"""{tag}p AS (SELECT i, 1 - 2 * exp(any_value(lgamma((free + 1) / 2.0) - lgamma(free / 2.0))) / sqrt(any_value(free) * pi()) * any_value(h) / 3
    * sum(CASE WHEN u IN (0, 2000) THEN 1 WHEN u % 2 = 1 THEN 4 ELSE 2 END * pow(1 + u * h * u * h / free, -(free + 1) / 2.0)) AS p
  FROM {tag}t, range(0, 2001) r(u) GROUP BY i)"""]
    select = f"""SELECT '{model_name}' AS model, term, round(est, 3) AS estimate, round(se, 4) AS std_error, round(t, 4) AS t_value,
       round(abs(p), 4) AS p_value, round(r2, 6) AS r2, n FROM {tag}t JOIN {tag}p USING (i) JOIN {tag}names USING (i)"""
    return ", ".join(ctes), select


def _sql_models(models: dict[str, dict[str, str]], src: str, y: str, start: str) -> str:
    parts = [_sql_model(name, src, y, columns, f"q{i}") for i, (name, columns) in enumerate(models.items())]
    return f"{start}, {', '.join(c for c, _ in parts)}\n" + "\nUNION ALL ".join(s for _, s in parts)


def _model_columns(df: DataFrame) -> DataFrame:
    return df.select("model", "term", F.round("estimate", 3).alias("estimate"), F.round("std_error", 4).alias("std_error"),
                     F.round("t_value", 4).alias("t_value"), F.round("p_value", 4).alias("p_value"),
                     F.round("r2", 6).alias("r2"), "n")


_SUMMARY_TERMS = ["c_acctbal", "c_nationkey", "o_orderstatus"]


@register("ols_summary", _sql_models({f"momTotalPrice ~ {' + '.join(_SUMMARY_TERMS)}": {
    "c_acctbal": "c_acctbal", "c_nationkey": "c_nationkey",
    **{f"o_orderstatus_{v}": f"(o_orderstatus = '{v}')::INT" for v in ("P", "O")}}}, "k", "momTotalPrice", _SQL_CODED))
def ols_summary(spark, sf_dir):
    """OLS with standard errors, t and p values, a factor among the predictors, from one scan."""
    return _model_columns(model.ols_summary(_model_table(spark, sf_dir), "momTotalPrice", _SUMMARY_TERMS))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("interaction_models", _sql_models({
    "status_code": {"c_acctbal": "c_acctbal", "c_nationkey:status_code": "c_nationkey * status_code"},
    "priority_code": {"c_acctbal": "c_acctbal", "c_nationkey:priority_code": "c_nationkey * priority_code"},
    "o_orderpriority": {"c_acctbal": "c_acctbal", **{
        f"c_nationkey:o_orderpriority_{v}": f"c_nationkey * (o_orderpriority = '{v}')::INT" for v in reversed(_PRIORITIES)}}},
    "k", "momTotalPrice", _SQL_CODED))
def interaction_models(spark, sf_dir):
    """One adjusted model per feature with a product term and no main effect, all from one scan."""
    return _model_columns(model.interaction_models(_model_table(spark, sf_dir), "momTotalPrice", ["c_acctbal"],
                                                   "c_nationkey", ["status_code", "priority_code", "o_orderpriority"]))


def _sql_ols2(src: str, y: str, x1: str, x2: str, names: tuple[str, str], ctes: str = "") -> str:
    """Two-predictor OLS with standard errors and t values from centred moments."""
    return f"""WITH {ctes}d AS (SELECT {y} AS y, {x1} AS x1, {x2} AS x2 FROM {src}
                 WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
             covar_pop(x1, x1) * count(*) AS s11, covar_pop(x2, x2) * count(*) AS s22,
             covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y,
             covar_pop(x2, y) * count(*) AS s2y, covar_pop(y, y) * count(*) AS syy FROM d),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM m),
c AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM b),
e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS sigma2 FROM c),
s AS (SELECT *, sqrt(sigma2 * s22 / det) AS se1, sqrt(sigma2 * s11 / det) AS se2,
             sqrt(sigma2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se0,
             1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2 FROM e)
SELECT '{names[0]}' AS term, round(b1, 3) AS estimate, round(se1, 4) AS std_error, round(b1 / se1, 4) AS t_value,
       round(r2, 6) AS r2, n FROM s
UNION ALL SELECT '{names[1]}', round(b2, 3), round(se2, 4), round(b2 / se2, 4), round(r2, 6), n FROM s
UNION ALL SELECT '(Intercept)', round(b0, 3), round(se0, 4), round(b0 / se0, 4), round(r2, 6), n FROM s"""


def _inference_columns(df: DataFrame) -> DataFrame:
    return df.select("term", F.round("estimate", 3).alias("estimate"), F.round("std_error", 4).alias("std_error"),
                     F.round("t_value", 4).alias("t_value"), F.round("r2", 6).alias("r2"), "n")


@register("ols_inference", _sql_ols2("lineitem", "l_extendedprice", "l_quantity", "l_discount",
                                     ("l_quantity", "l_discount")))
def ols_inference(spark, sf_dir):
    """OLS estimates with standard errors, t values and R^2 (p values in ``ols_summary``)."""
    s = model.ols_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return _inference_columns(s)


@register("interaction_term", _sql_ols2(
    "k", "momTotalPrice", "c_nationkey", "prod", ("c_nationkey", "c_acctbal:status_code"),
    ctes=f"j AS ({_SQL_MOM_BASE}), k AS (SELECT momTotalPrice, c_nationkey, c_acctbal * CASE o_orderstatus "
         "WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 ELSE -1 END AS prod FROM j), "))
def interaction_term(spark, sf_dir):
    """Adjusted model with a product term and no main effect of the feature."""
    j = _model_table(spark, sf_dir)
    s = model.ols_summary(j, "momTotalPrice", ["c_nationkey", "c_acctbal:status_code"])
    return _inference_columns(s)
