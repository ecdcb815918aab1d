"""Distributed ranks, prefix sums and dominance counts.

A dominance count asks, for every row, the weight of the rows that are smaller in two ranks.
Neither a join of all pairs nor a grid of the two ranks is built: a rank is cut into digits.
A row's predecessors in rank ``a`` are the left siblings on its path through the digit tree
of ``a``, and within those nodes the rows with a smaller ``b`` are running sums in the order
of ``b``.  So n rows take n log n steps.

Tree nodes near the root hold many rows.  The ranks are therefore cut into strips of equal
size first: within a strip of ``a`` the tree is small; rows of other strips count by whole
strips, once within the row's own strip of ``b`` and once for whole strips in both ranks, a
table of strip pairs.  A strip's rows are counted in one task (in numpy), the strip pairs by
windows whose partitions are tree nodes; no task holds more than a strip or a window of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import handover

#: Digits of a strip's size: strips of at most 2^16 rows, and at least 16 of them.
MOST_DIGITS, LEAST_DIGITS, STRIPS_LOG = 16, 3, 4
#: Binary digits per step down the tree.
BITS = 4
#: Small sides of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: monotonically_increasing_id holds the partition above this digit, the row's place below.
PLACE_DIGITS = 33


def strip_digits(n_rows: int) -> int:
    return max(LEAST_DIGITS, min(MOST_DIGITS, n_rows.bit_length() - 1 - STRIPS_LOG))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` stored, and marked for broadcast if a count shows at most ``most`` rows."""
    df = handover(df, "small_side")
    return F.broadcast(df) if df.count() <= most else df


def ranked(df: DataFrame, order: Sequence[Column], out: str, parts: int) -> DataFrame:
    """Rows numbered 0, 1, ... by a total ``order``, without a single-task window (column ``out``).

    Range partitions are sorted and numbered in themselves; the table is stored, so every
    later reader sees the same numbers, and the partitions' sizes (``parts`` numbers) give
    the offsets.
    """
    spark = df.sparkSession
    placed = handover(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                      .withColumn("__id", F.monotonically_increasing_id()), f"ranked_{out}")
    part = F.shiftright("__id", PLACE_DIGITS)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = accumulate([0, *(n for _, n in sizes)])
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "__part long, __start long")
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_DIGITS) - 1))
    return numbered.withColumn(out, F.col("__start") + place).drop("__id", "__part", "__start")


def mass_before(df: DataFrame, group: str, rank: str, weight: str, digits: int, out: str) -> DataFrame:
    """Adds the weight of the group's rows with a smaller ``rank``: strip totals, then a running
    sum within the strip."""
    strip = F.shiftright(rank, digits)
    strips = df.groupBy(group, strip.alias("__strip")).agg(F.sum(weight).alias("__mass"))
    earlier = Window.partitionBy(group).orderBy("__strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = small(strips.select(group, "__strip", F.coalesce(F.sum("__mass").over(earlier), F.lit(0.0)).alias("__before")))
    within = Window.partitionBy(group, "__strip").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__strip", strip).withColumn("__own", F.coalesce(F.sum(weight).over(within), F.lit(0.0)))
            .join(strips, [group, "__strip"]).withColumn(out, F.col("__before") + F.col("__own"))
            .drop("__strip", "__own", "__before"))


def _left_siblings(df: DataFrame, part: Sequence[str], a: str, digits: int, b: str, weight: str) -> DataFrame:
    """Every row once per digit of ``a``, with ``__left``: the weight of the rows with a smaller
    ``b`` in the left siblings of its node of that digit (null where there are none).

    Digits have :data:`BITS` bits: a row then takes part in fewer windows, each with a running
    sum per digit, and one sort serves all of a window's sums.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit((max(digits, 1) - 1) // BITS)))
    rows = (df.withColumn("__level", level).withColumn("__node", F.expr(f"shiftright({a}, {BITS} * (__level + 1))"))
            .withColumn("__digit", F.expr(f"shiftright({a} & {(1 << max(digits, 1)) - 1}L, {BITS} * __level) & {(1 << BITS) - 1}")))
    node = Window.partitionBy(*part, "__level", "__node").orderBy(b).rangeBetween(Window.unboundedPreceding, -1)
    last = (1 << min(BITS, max(digits, 1))) - 1
    sums = [f"__sum{d}" for d in range(last)]
    rows = rows.select("*", *[F.sum(F.when(F.col("__digit") == d, F.col(weight))).over(node).alias(s) for d, s in enumerate(sums)])
    left = sum((F.when(F.col("__digit") > d, F.coalesce(s, F.lit(0.0))).otherwise(F.lit(0.0)) for d, s in enumerate(sums)), F.lit(0.0))
    return rows.withColumn("__left", F.when(left > 0, left)).drop(*sums)


def smaller_in_both(df: DataFrame, part: Sequence[str], a: str, digits: int, b: str, weight: str, key: Sequence[str]) -> DataFrame:
    """(key, mass): weight of the rows of the same ``part`` with a smaller ``a`` and a smaller ``b``.

    ``a`` and ``b`` are whole numbers, of ``a`` only the last ``digits`` binary digits count.
    Rows without any predecessor are absent.
    """
    rows = _left_siblings(df.select(*dict.fromkeys([*part, *key, a, b, weight])), part, a, digits, b, weight)
    return rows.where("__left IS NOT NULL").groupBy(*key).agg(F.sum("__left").alias("mass"))


def with_smaller_in_both(df: DataFrame, part: Sequence[str], a: str, digits: int, b: str, weight: str, key: Sequence[str],
                         out: str) -> DataFrame:
    """``df`` with the mass of :func:`smaller_in_both` as a column: carried along, no join.  For
    tables of one strip, whose windows and aggregate share the exchange on ``part``."""
    rows = _left_siblings(df, part, a, digits, b, weight)
    rest = [c for c in df.columns if c not in key]
    return rows.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.coalesce(F.sum("__left"), F.lit(0.0)).alias(out))


def _in_strips(df: DataFrame, strip: Sequence[str], a: str, b: str, weight: str, out: str) -> DataFrame:
    """Adds the weight of the rows of the same ``strip`` with a smaller ``a`` and a smaller ``b``.

    A strip's rows go to one task, which takes them down the binary digits of ``a`` in the order of
    ``b``, with one running sum per digit: the rows are moved once, and not once per digit.
    ``a`` and ``b`` are whole numbers, ``b`` unique; the weights are counts.
    """
    def mass(table):
        import numpy as np
        import pyarrow as pa

        of = lambda name: table.column(name).to_numpy()
        by_b = np.argsort(of(b), kind="stable")
        code = np.unique(of(a), return_inverse=True)[1][by_b].astype(np.uint16 if len(by_b) <= 1 << 16 else np.int64)
        own = of(weight)[by_b]
        sums = np.zeros(len(code))
        for digit in range(int(code.max()).bit_length()):
            node = code >> (digit + 1)
            at = np.argsort(node, kind="stable")
            right = (code[at] >> digit) & 1 == 1
            left = np.where(right, 0.0, own[at])
            total = np.cumsum(left)
            starts = np.flatnonzero(np.diff(node[at].astype(np.int64), prepend=-1))
            before = np.repeat((total - left)[starts], np.diff(np.append(starts, len(at))))
            sums[at] += np.where(right, total - before, 0.0)
        result = np.empty(len(code))
        result[by_b] = sums
        return table.append_column(out, pa.array(result))

    return df.groupBy(*strip).applyInArrow(mass, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def dominated(df: DataFrame, group: str, a: str, b: str, weight: str, n_rows: int, out: str) -> DataFrame:
    """Adds the weight of the rows of the same ``group`` that are smaller in both ranks.

    ``a`` and ``b`` are unique numbers below ``n_rows``, by which ``group`` is contiguous.
    """
    digits = strip_digits(n_rows)
    high = max((max(n_rows, 1) - 1 >> digits).bit_length(), 1)
    df = df.withColumn("__sa", F.shiftright(a, digits)).withColumn("__sb", F.shiftright(b, digits))
    pairs = df.groupBy(group, "__sa", "__sb").agg(F.sum(weight).alias("__mass"))
    far = smaller_in_both(pairs, [group], "__sa", high, "__sb", "__mass", [group, "__sa", "__sb"]).withColumnRenamed("mass", "__far")
    # whole strips smaller in both, unlike rows of the own strip of b, are counted for every row of the strip pair
    df = _in_strips(df, [group, "__sa"], a, b, weight, "__near")
    df = _in_strips(df, [group, "__sb"], "__sa", b, weight, "__aside")
    return (df.join(small(far), [group, "__sa", "__sb"], "left")
            .withColumn(out, F.col("__near") + F.col("__aside") + F.coalesce("__far", F.lit(0.0))).drop("__sa", "__sb", "__near", "__aside", "__far"))
