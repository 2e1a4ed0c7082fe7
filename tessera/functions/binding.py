"""Values evaluated once per row and used many times inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` as the variable of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)
