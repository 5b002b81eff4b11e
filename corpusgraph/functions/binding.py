"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Projections collapse, so a derived array referenced inside a lambda would
    be rebuilt for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
