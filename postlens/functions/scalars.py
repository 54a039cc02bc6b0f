"""Global scalars (quantiles, defaults, totals) attached to rows as scalar
subqueries: the one-row frame is computed once, its value is substituted into
the row expressions — no join, nothing shuffled or broadcast per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_struct(one_row: DataFrame) -> Column:
    """All columns of a frame with at most one row, as one struct-valued scalar
    subquery (null when the frame is empty)."""
    return one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("s")).scalar()


def scalar(one_row: DataFrame, col: str | None = None) -> Column:
    """One column of a frame with at most one row, as a scalar subquery."""
    return one_row.select(col or one_row.columns[0]).scalar()
