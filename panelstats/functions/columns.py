"""Row-wise column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def first_non_null(*cols: str | Column) -> Column:
    """First non-null of the columns, left wins (C10: indoor answer over outdoor)."""
    return F.coalesce(*[_c(c) for c in cols])


def or_missing(c: str | Column, marker: str = "NA") -> Column:
    """The value, or ``marker`` when null (C11: "does not apply here")."""
    return F.coalesce(_c(c), F.lit(marker))


def value_or_text(value: str | Column, text: str | Column, no_value: str = "None") -> Column:
    """``value`` unless it starts with ``no_value``, then ``text``; null value stays null."""
    v = _c(value)
    return F.when(v.startswith(no_value), _c(text)).otherwise(v)


def composite_sum(cols: Sequence[str | Column]) -> Column:
    """Row-wise sum of item scores; null if any item is missing or not numeric."""
    # A higher-order function keeps Spark from one method for a whole wide row, too long to be compiled;
    # -0.0 changes no sum.
    return F.aggregate(F.array(*[_c(c).try_cast("double") for c in cols]), F.lit(-0.0), add)


def products(base: str | Column, factors: Mapping[str, str | Column]) -> dict[str, Column]:
    """Interaction columns ``name -> base * factor`` for ``withColumns`` (C14)."""
    b = _c(base)
    return {name: b * _c(f) for name, f in factors.items()}


def sparse_columns(key: str | Column, value: str | Column, keys: Sequence[str]) -> list[Column]:
    """One column per key: the value where the row's key matches, else null."""
    k, v = _c(key), _c(value)
    return [F.when(k == q, v).alias(q) for q in keys]
