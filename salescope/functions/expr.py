"""Column expressions shared by the operators (all built-in, all inside whole-stage codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns an operator may filter or group on by name (identifiers are whitelisted, never spliced).
DIMENSIONS = frozenset({
    "Year", "Month_and_Year", "Month_and_Year_Sort", "Invoice_Date", "Invoice_No", "Invoice_Type",
    "Item_Code", "Item_Desc", "Brand", "Brand_Mask", "Salesman", "Manager", "GM", "Customer_Name", "Group",
    "Emirate", "Channel",
})


def dim(name: str) -> str:
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}")
    return name


def money(c: Column | str) -> Column:
    """Decimal sum -> double once, at the end."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero denominator (SQL NULLIF semantics, ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def zero_if_null(c: Column) -> Column:
    """pandas ``replace([inf, -inf], 0).fillna(0)`` after a division."""
    return F.coalesce(c, F.lit(0.0))


def sum_when(cond: Column, value: Column | str) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END) for decimal money or integer quantities."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def avg_of(value: Column) -> Column:
    """AVG as cast(sum as double)/count, identical across engines."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def equals_all(filters: dict | None) -> Column | None:
    """Conjunction of ``col == value`` from a dict."""
    if not filters:
        return None
    return reduce(lambda a, b: a & b, [F.col(dim(k)) == F.lit(v) for k, v in filters.items()])


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    cond = equals_all(filters)
    return df if cond is None else df.filter(cond)


def optional_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Filter unless the value is None / '' / 'All'."""
    if value is None or value == "" or value == "All":
        return df
    return df.filter(F.col(dim(column)) == F.lit(value))


def brand_filter(brand: str, use_brand_mask: bool = False) -> Column:
    """``Brand = b`` or case-insensitive ``Brand_Mask LIKE '%b%'`` (SQLite LIKE ignores ASCII case)."""
    if use_brand_mask:
        return F.col("Brand_Mask").ilike(f"%{brand}%")
    return F.col("Brand") == F.lit(brand)


def not_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != F.lit(""))


def thousands(c: Column) -> Column:
    """F16: thousands separators, no decimals ('1,234,568')."""
    return F.format_number(c.cast("double"), 0)


def pct_text(c: Column, digits: int = 2) -> Column:
    """percentage text ('12.35%'), 'N/A' for NULL."""
    return F.coalesce(F.concat(F.format_number(c.cast("double"), digits).cast("string"), F.lit("%")), F.lit("N/A"))


def money_text(c: Column, currency: str = "AED", digits: int = 2) -> Column:
    """Currency text used by the report tables ('AED 1,234.50')."""
    return F.concat(F.lit(currency + " "), F.format_number(c.cast("double"), digits))


def month_number(mon3: Column) -> Column:
    """'Jan'..'Dec' -> 1..12 by parsing, for calendar ordering."""
    return F.month(F.to_date(F.concat(F.lit("01 "), mon3, F.lit(" 2000")), "dd MMM yyyy"))
