"""Let-binding for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, even where the optimizer inlines it or pushes it into a filter."""
    return F.element_at(F.transform(F.array(value), use), 1)
