"""Filter interaction audit by exact constrained least squares (operator 13).

Every document is reduced to the set of filters that it fails, and per part (a value of the
part column) the documents are tabulated for all 2^k coalitions of filters: v(S) documents
fail some filter of S, so v is what a coalition removes in whatever order.  Two results are
read from that table alone, so the documents are scanned once however many orders there are:

* step counts of an order are differences of coalitions, v(S + f) - v(S) with S the filters
  before f;
* Shapley values are the solution of the kernel-weighted least squares fit of v by a sum of
  one number per filter, constrained to add up to v(all).  The normal equations depend on k
  only.  They are solved once, in rationals, for every unit table, which gives the values as
  a linear map of the 2^k numbers; multiplied by k! its entries are whole, so the sums over
  all orders are exact 64-bit integers.

A document fails the copy filter if a smaller id has the same text: texts are compared by
SHA-256, the smallest id of each text comes from one aggregate (combined before its shuffle,
so a text that a third of the documents share is no hot group), and documents meet it by
(text, id), which spreads such a text over all tasks.

Edge cases: a null text is empty; a null part is the empty string; a document without id is
no copy and makes no copy, and has no labels; rows with equal id and text count each and are no copies of one
another; a label counts if any of an id's label rows has it, null labels do not; texts may
be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, UPPER, pick, written

LEAST_WORDS = 200
SYMBOLS = "[#$%&*|]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by filter letter."""
    words = words_of(text)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 2 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of ``matrix`` X = ``right`` by Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [[*m, *r] for m, r in zip(matrix, right, strict=True)]
    for i in range(n):
        at = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_map(k: int) -> list[list[int]]:
    """Per filter, the weight of each coalition (bit i of its number is filter i) in the sum
    over all orders of what the filter removes.

    Minimise the sum over proper coalitions S of w(S) (v(S) - sum of x_i in S)^2 subject to
    sum of x_i = v(all) - v(none), with w(S) = (k-1) / (C(k,|S|) |S| (k-|S|)): the normal
    equations with one multiplier, solved for the 2^k unit vectors v at once.
    """
    full = (1 << k) - 1
    weight = {s: Fraction(k - 1, comb(k, n) * n * (k - n)) for s in range(1, full) if (n := s.bit_count())}
    if k == 1:
        return [[-1, 1]]
    has = lambda s, i: s >> i & 1
    matrix = [[sum((w for s, w in weight.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(k)] + [Fraction(1)] for i in range(k)]
    matrix.append([Fraction(1)] * k + [Fraction(0)])
    right = [[weight.get(s, Fraction(0)) * has(s, i) for s in range(full + 1)] for i in range(k)]
    right.append([Fraction(int(s == full) - int(s == 0)) for s in range(full + 1)])
    # v(none) enters the fit as the model's constant: shift every coalition by it
    for row in right[:k]:
        row[0] -= sum(row[1:])
    found = [[x * factorial(k) for x in row] for row in solved(matrix, right)[:k]]
    if any(x.denominator != 1 for row in found for x in row):
        raise ArithmeticError("the weights of all orders are whole numbers")
    return [[int(x) for x in row] for row in found]


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters (bit i: i-th letter)."""
    docs = pick(docs, doc_id="long", text="string", **{part: "string"})
    text = F.coalesce("text", F.lit(""))
    alone = sum((F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(text_rules(text).values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"), alone.alias("alone"))
    rows = written(rows.groupBy("doc_id", "part", "h", "alone").agg(F.count("*").alias("n")), "failures")

    first = rows.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(text_rules(text)))).otherwise(F.lit(0))
    marked = rows.join(first, ["doc_id", "h"], "left").join(marks, "doc_id", "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return marked.groupBy("part", (F.col("alone") + copy).alias("mask")).agg(F.sum("n").alias("n"), times("good"), times("toxic"))


def coalitions(failed: DataFrame, k: int, counts: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """(part, total, and per count an array of 2^k): how many of a part each coalition removes."""
    removed = lambda c, s: F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(F.lit(0)))
    return failed.groupBy("part").agg(F.sum("n").alias("total"), *(F.array(*(removed(c, s) for s in range(1 << k))).alias(c) for c in counts))


def audit(table: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the table of :func:`coalitions`."""
    k = len(letters)
    full = (1 << k) - 1
    orders = " ".join("".join(o) for o in permutations(letters))
    mask = lambda some: sum((F.when(F.contains(some, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    own_sums = [sum((F.get("n", F.lit(s)) * w for s, w in enumerate(row) if w), F.lit(0)) for row in shapley_map(k)]
    table = table.withColumn("sums", F.array(*own_sums))
    rows = (table.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("letter", F.expr("substr(filter_order, step, 1)"))
            .withColumn("own", mask(F.col("letter"))).withColumn("before", mask(F.expr("substr(filter_order, 1, step - 1)"))))
    v = lambda of, s: F.get(of, s)
    upto = F.col("before").bitwiseOR(F.col("own"))
    gained = lambda of: v(of, upto) - v(of, F.col("before"))
    index = F.instr(F.lit(letters), F.col("letter")) - 1
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - v("n", upto)).alias("kept"), gained("n").alias("removed"),
        (v("n", F.col("own")) - gained("n")).alias("redundant"),
        (v("n", F.lit(full)) - v("n", F.lit(full) - F.col("own"))).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"), v("sums", index).alias("shapley"))


def run(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over whole ``docs`` (doc_id, text, ``part``) and ``labels``."""
    letters = "".join(text_rules(F.lit(""))) + "E"
    return audit(coalitions(failures(docs, labels, part), len(letters)), letters)


def oracle(letters: Mapping[str, str] | None = None) -> str:
    """DuckDB SQL of the query: orders are walked one by one over the documents' failure sets."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    rules = letters or {
        "A": f"len({words}) < 200", "B": f"100 * len(list_distinct({words})) < 50 * len({words})",
        "C": r"100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t)", "D": r"regexp_matches(t, '[#$%&*|]')",
        "E": "doc_id > first_id"}
    flags = ", ".join(f"CASE WHEN {rule} THEN '{c}' ELSE '' END" for c, rule in rules.items())
    names = ", ".join(f"('{c}')" for c in rules)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
f AS (SELECT doc_id, part, concat({flags}) AS failed FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
letters(c) AS (VALUES {names}),
orders AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z
           WHERE b.c <> a.c AND x.c NOT IN (a.c, b.c) AND y.c NOT IN (a.c, b.c, x.c) AND z.c NOT IN (a.c, b.c, x.c, y.c)),
walked AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
           FROM orders, range(1, 6) r(step)),
hit AS (SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS alone,
               length(translate(failed, before, '')) < length(failed) AS gone
        FROM m, walked),
counted AS (SELECT part, filter_order, step, own,
       sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
       sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
       sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
       sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
       sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
       sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
       FROM hit GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted"""
