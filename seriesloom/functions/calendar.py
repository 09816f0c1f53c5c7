"""Calendar expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.expressions import as_col

# The months each season flag covers.
FESTIVAL_MONTHS = (10, 11)
PRE_FESTIVAL_MONTHS = (8, 9)
BUDGET_MONTHS = (2,)
PRE_BUDGET_MONTHS = (1,)
POST_BUDGET_MONTHS = (3,)
HOLIDAY_MONTHS = (3, 9, 10, 11, 12)


def month_start(c: str | Column) -> Column:
    return F.trunc(as_col(c).cast("date"), "month")


def wave(fn, c: str | Column, period: int) -> Column:
    """``fn(2 pi c / period)`` for ``fn`` in sin, cos."""
    return fn(as_col(c) * F.lit(2 * math.pi / period))


def in_months(date: str | Column, months: Sequence[int]) -> Column:
    return F.month(as_col(date)).isin(*months).cast("int")


def month_end_after(last: str | Column, steps: str | Column) -> Column:
    """End of the month that lies ``steps`` months after ``last``."""
    return F.last_day(F.add_months(as_col(last), as_col(steps)))
