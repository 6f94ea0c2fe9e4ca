"""Names for intermediate values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often `use` names it: nested conditions over a long
    expression would otherwise repeat it at every level, in the plan and in the work."""
    return F.transform(F.array(value), use)[0]
