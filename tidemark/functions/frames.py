"""Trailing ROWS frames and null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rows(first: int, last: int = 0) -> WindowSpec:
    """Rows first .. last relative to the current one, within a chunk of a series."""
    return W.partitionBy("series_key", "chunk").orderBy("rn").rowsBetween(first, last)


#: A frame whose length is a column is measured in so many parts of that length, give or take.
UNIT, SLACK = 1_000_000, 1_000


def _measured(size: Column) -> WindowSpec:
    """Rows in steps of UNIT / size, so that a frame of UNIT reaches `size` rows (below 900) whatever a series' size is."""
    at = F.floor(F.col("rn") * UNIT / size)
    return W.partitionBy("series_key", "chunk").orderBy(at)


def before(size: int | Column) -> WindowSpec:
    """The `size` rows before each row; a column holds one size for each series."""
    if isinstance(size, Column):
        return _measured(size).rangeBetween(-UNIT - SLACK, -SLACK)
    return rows(-size, -1)


def shortest(most: int, size: int | Column) -> int | Column:
    return F.least(F.lit(most), size) if isinstance(size, Column) else min(most, size)


def ordered() -> WindowSpec:
    return W.partitionBy("series_key", "chunk").orderBy("rn")


def lag(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(ordered())


def lead(column: str, k: int | Column) -> Column:
    if isinstance(k, Column):
        return F.first(column).over(_measured(k).rangeBetween(UNIT - SLACK, UNIT + SLACK))
    return F.lead(column, k).over(ordered())


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or the result is not finite."""
    q = F.try_divide(a, b)
    return F.when(~F.isnan(q) & (F.abs(q) != float("inf")), q)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def return_over(column: str, k: int) -> Column:
    """Relative change over k rows."""
    return ratio(F.col(column), lag(column, k)) - 1
