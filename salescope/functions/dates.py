"""As-of windows.

The reference measures every rolling window from the wall clock; here every operator takes an
explicit ``as_of`` date. Cut-offs are Spark expressions over literals, so Catalyst folds them to
constants and the predicates reach the Parquet scan. Month arithmetic clamps to month end
(``add_months``), which differs from the overflowing SQLite form only on days 29-31.

Each window filter also adds the redundant ``Year >= year(cutoff)`` predicate so a table
partitioned by ``Year`` is pruned (date -> partition inference is not automatic).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_COL = "Invoice_Date"


def as_date(as_of: dt.date | str | None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def months_ago(as_of, n: int) -> Column:
    return F.add_months(as_date(as_of), -int(n))


def days_ago(as_of, n: int) -> Column:
    return F.date_sub(as_date(as_of), int(n))


def on_or_after(cutoff: Column, col: str = DATE_COL) -> Column:
    """``col >= cutoff`` plus the partition-pruning companion on ``Year``."""
    return (F.col(col) >= cutoff) & (F.col("Year") >= F.year(cutoff))


def since(df: DataFrame, cutoff: Column, col: str = DATE_COL) -> DataFrame:
    return df.filter(on_or_after(cutoff, col))


def year_month(col: str = DATE_COL) -> Column:
    """``yyyy-MM`` month key of a date (strftime('%Y-%m'))."""
    return F.date_format(F.col(col), "yyyy-MM")
