"""Code-books held as data.

Two lookups, chosen by the shape of the book:

* **Ordinal scoring** (C5/C6): rules keyed by a *range* of question ids and an
  answer text.  The book keeps the ranges as intervals, one row each, however
  many ids they span; intervals of one answer are disjoint (checked), so a row
  matches at most one.  The book is joined on the answer, the id being compared
  with the answer's intervals, or searched among them by halving where an answer
  has many.  The book's size is known on the driver before any job runs, so it
  is broadcast only below a fixed bound; above it the join is left to the
  planner (AQE measures it at run time).
* **Categorical encoding** (C7-C9): a handful of answers per column.  Each column
  becomes one ``CASE`` expression inside a single projection (``withColumns``),
  so no join or shuffle is planned at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above this many intervals the book is not broadcast by hint.
MAX_BROADCAST_ENTRIES = 1_000_000

_LO, _HI, _ANSWER, _SCORE = "__cb_lo", "__cb_hi", "__cb_answer", "__cb_score"


@dataclass(frozen=True)
class OrdinalRule:
    """Answer text ``answer`` to any question id in ``ids`` (ids, or a range of them) scores ``score``."""

    ids: tuple[int, ...] | range
    answer: str
    score: str | int


def id_range(lo: int, hi: int) -> range:
    """Question ids ``lo..hi`` inclusive; never expanded, so it may span any number of ids."""
    return range(lo, hi + 1)


def intervals(rule: OrdinalRule) -> list[tuple[int, int]]:
    """The rule's ids as inclusive intervals, in order."""
    if isinstance(rule.ids, range) and rule.ids.step == 1:
        return [(rule.ids.start, rule.ids.stop - 1)] if rule.ids else []
    out: list[tuple[int, int]] = []
    for i in sorted(set(rule.ids)):
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def check_rules(rules: Sequence[OrdinalRule]) -> list[tuple[str, int, int, str | int]]:
    """(answer, lo, hi, score) of every interval, sorted; rejects rules without ids and any
    (id, answer) matched by two rules."""
    book = []
    for r in rules:
        own = intervals(r)
        if not own:
            raise ValueError(f"rule without question ids: {r}")
        if not isinstance(r.ids, range) and len(set(r.ids)) < len(r.ids):
            raise ValueError(f"rule that names a question twice: {r}")
        book += [(r.answer, lo, hi, r.score) for lo, hi in own]
    book.sort(key=lambda b: (b[0], b[1]))
    for (a, _, hi, _), (b, lo, _, _) in zip(book, book[1:]):
        if a == b and lo <= hi:
            raise ValueError(f"two rules for question {lo} and answer {a!r}")
    return book


def codebook_frame(spark: SparkSession, rules: Sequence[OrdinalRule],
                   score_type: T.DataType = T.StringType()) -> DataFrame:
    """The book as a DataFrame, one row per interval of question ids and answer."""
    schema = T.StructType([
        T.StructField(_ANSWER, T.StringType(), False), T.StructField(_LO, T.LongType(), False),
        T.StructField(_HI, T.LongType(), False), T.StructField(_SCORE, score_type, False),
    ])
    cast = str if isinstance(score_type, T.StringType) else int
    return spark.createDataFrame([(a, lo, hi, cast(s)) for a, lo, hi, s in check_rules(rules)], schema)


# An answer with up to this many intervals is looked up by comparing the id with each of them
# inside the hash join; with more, by binary search.  Only the plan depends on it.
SCAN_LIMIT = 64


def _searched(df: DataFrame, question: Column, book: DataFrame, steps: list[int], same: Callable) -> DataFrame:
    """``df`` with the score of the interval that holds the id, null where none does: one book row
    per answer, holding its intervals in order, searched by halving steps."""
    rows = (book.groupBy(_ANSWER).agg(F.array_sort(F.collect_list(F.struct(_LO, _HI, _SCORE))).alias("__cb_book"))
            .withColumn("__cb_los", F.col(f"__cb_book.{_LO}")))
    joined = df.join(F.broadcast(rows), same(rows), "left")
    start = lambda at: F.get("__cb_los", at - 1)
    upto = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, s: at + F.when(start(at + s) <= question, s).otherwise(F.lit(0)))
    hit = F.get("__cb_book", upto - 1)
    return (joined.withColumn("__cb_hit", hit)
            .withColumn(_SCORE, F.when(question <= F.col(f"__cb_hit.{_HI}"), F.col(f"__cb_hit.{_SCORE}")))
            .drop("__cb_book", "__cb_los", "__cb_hit"))


def score_answers(df: DataFrame, id_col: str, answer_col: str, rules: Sequence[OrdinalRule],
                  out_col: str = "ValidatedScore", default: object = "answer",
                  score_type: T.DataType = T.StringType()) -> DataFrame:
    """Ordinal scoring by code-book.

    Adds ``out_col``: the score of the matching rule; unmatched rows get the
    answer text when ``default == "answer"`` (C5), else the literal ``default``
    (C6, e.g. ``-1``).  A null answer never matches (so it gets the default);
    a null question id gives a null score.
    """
    entries = check_rules(rules)
    book = codebook_frame(df.sparkSession, rules, score_type)
    question, answer = df[id_col], df[answer_col]
    most = max(Counter(a for a, *_ in entries).values(), default=0)
    if most > SCAN_LIMIT:
        steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
        joined = _searched(df, question, book, steps, lambda rows: answer == rows[_ANSWER])
    else:
        if len(entries) <= MAX_BROADCAST_ENTRIES:
            book = F.broadcast(book)
        joined = df.join(book, (answer == book[_ANSWER]) & question.between(book[_LO], book[_HI]), "left")
    fallback = joined[answer_col] if default == "answer" else F.lit(default).cast(score_type)
    score = F.when(joined[id_col].isNotNull(), F.coalesce(F.col(_SCORE), fallback))
    return joined.withColumn(out_col, score).drop(_LO, _HI, _ANSWER, _SCORE)


def _text(c: str | Column) -> Column:
    c = F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c
    return c.cast("string")


def category_code(c: str | Column, book: Mapping[str, int], missing: int | None = -1) -> Column:
    """``CASE c WHEN answer THEN code ... ELSE missing END`` (C7-C9); answers compare as text."""
    c = _text(c)
    expr = None
    for answer, code in book.items():
        expr = (F.when(c == answer, F.lit(code)) if expr is None
                else expr.when(c == answer, F.lit(code)))
    if expr is None:
        return F.lit(missing).cast("int")
    return expr.otherwise(F.lit(missing)).cast("int")


# Books up to this many answers become CASE expressions; larger ones a lookup join.
# Only the plan depends on it: comparison (as text), names and column order do not.
CASE_LIMIT = 64


def encode_categories(df: DataFrame, books: Mapping[str, Mapping[str, int]],
                      suffix: str = "_numeric", missing: int | None = -1,
                      names: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``<column><suffix>`` codes for every column in ``books`` in one projection.

    Answers not in the column's book, and nulls, get ``missing`` (-1 in the
    reference; ``None`` keeps them null so models skip the row).  Answers are
    compared as text whatever the column's type.  Books of up to ``CASE_LIMIT``
    answers are inlined as ``CASE`` (no join); a larger book is joined as a
    table, broadcast while its size, known here, is small.
    """
    names = names or {}
    joined, codes = df, {}
    for i, (c, book) in enumerate(books.items()):
        out = names.get(c, c + suffix)
        if len(book) <= CASE_LIMIT:
            codes[out] = category_code(c, book, missing)
            continue
        key, code = f"__book_answer_{i}", f"__book_code_{i}"
        table = df.sparkSession.createDataFrame(list(book.items()), f"{key} string, {code} int")
        if len(book) <= MAX_BROADCAST_ENTRIES:
            table = F.broadcast(table)
        joined = joined.join(table, _text(c) == F.col(key), "left")
        codes[out] = F.coalesce(F.col(code), F.lit(missing).cast("int"))
    return joined.withColumns(codes).drop(*[f"__book_{x}_{i}" for i in range(len(books)) for x in ("answer", "code")])
