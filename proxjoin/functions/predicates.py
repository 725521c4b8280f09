"""Conjunctive comparison clauses as column predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, ge, gt, le, lt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = {"gt": gt, "gte": ge, "lt": lt, "lte": le}


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def clause(df: DataFrame, field: str, operator: str, value, compat_eq: str = "typed") -> Column:
    """One clause. ``eq`` on a number compares numbers, or what is printed if ``compat_eq`` is ``string``."""
    kind, column = df.schema[field].dataType, F.col(f"`{field}`")
    if operator == "eq":
        if isinstance(kind, T.NumericType) and compat_eq != "string":
            return column == F.lit(float(value))
        return column.cast("string") == F.lit(_text(value))
    if operator not in ORDER:
        raise ValueError(f"unknown operator {operator!r}; known: eq, {', '.join(ORDER)}")
    return ORDER[operator](column.try_cast("double"), F.lit(float(value)))


def where(df: DataFrame, stream: str, clauses: Iterable, compat_eq: str = "typed") -> DataFrame:
    """The rows of ``stream`` that meet all of its clauses; those of other streams say nothing. None at all is true."""
    own = [clause(df, c.field, c.operator, c.value, compat_eq) for c in clauses if c.stream == stream]
    return df.where(reduce(and_, own)) if own else df


def members(df: DataFrame, streams: Iterable[str], column: str = "streamId") -> DataFrame:
    """The rows of streams that some query uses."""
    return df.where(F.col(column).isin(sorted(set(streams))))
