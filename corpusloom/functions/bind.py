"""Binding an expression to a name inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer inlines an alias that is referenced once, even into a lambda that runs for every array element. A lambda
    variable holds the computed value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
