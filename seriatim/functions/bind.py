"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(text: Column, kind: str = "bigint") -> Column:
    """A digits-only text as a number; null when empty or too long.

    Empty text is sorted out first: trying to cast it raises and catches an
    exception for every row.
    """
    return F.nullif(text, F.lit("")).try_cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it.

    Without it every mention repeats the whole expression, a regular expression
    over a page's text included.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
