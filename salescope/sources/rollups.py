"""Rollup and dimensions kept beside the facts, one partition a year, made at load.

``item_days`` has one row for each item, customer, channel and day. It holds what sums, distinct counts and line
averages need: amount, quantity, lines, lines with an amount, and the invoices. An operator that groups by item, brand,
customer, channel or date gives the same figures from it as from the fact, whose other columns it never reads.

``items`` and ``accounts`` list what was ever sold, and to whom, with first and last day. Listing brands, items or
customers reads these few rows, not all history. A dimension is kept by year: a load makes its own years anew, and
the entries of all years together are the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_DAY_KEYS = ["Year", "Invoice_Date", "Brand", "Item_Code", "Item_Desc", "Customer_Name", "Channel"]
LINE_COLUMNS = [*ITEM_DAY_KEYS, "Amount", "Regular_Qty", "Invoice_No"]  # of the fact, that the rollup reads
ITEM_KEYS = ["Year", "Item_Code", "Item_Desc", "Brand"]
ACCOUNT_KEYS = ["Year", "Customer_Name", "Group", "Brand"]


def item_days(sales: DataFrame) -> DataFrame:
    return sales.groupBy(*ITEM_DAY_KEYS).agg(
        F.sum("Amount").cast("decimal(18,2)").alias("Amount"),
        F.sum("Regular_Qty").alias("Regular_Qty"),
        F.count(F.lit(1)).alias("Lines"),
        F.count("Amount").alias("Priced_Lines"),
        F.array_sort(F.collect_set("Invoice_No")).alias("Invoices"),  # of one item, customer and day
    )


def _listed(sales: DataFrame, keys: list[str]) -> DataFrame:
    return sales.groupBy(*keys).agg(F.min("Invoice_Date").alias("First_Date"), F.max("Invoice_Date").alias("Last_Date"),
                                    F.count(F.lit(1)).alias("Lines"))


def items(sales: DataFrame) -> DataFrame:
    return _listed(sales, ITEM_KEYS)


def accounts(sales: DataFrame) -> DataFrame:
    return _listed(sales, ACCOUNT_KEYS)


# ---- what a row of the fact, or of the rollup, stands for ------------------------------------------

def lines(df: DataFrame) -> Column:
    return F.col("Lines") if "Lines" in df.columns else F.lit(1).cast("bigint")


def priced_lines(df: DataFrame) -> Column:
    return F.col("Priced_Lines") if "Lines" in df.columns else F.when(F.col("Amount").isNotNull(), 1).otherwise(0).cast("bigint")


def invoices(df: DataFrame) -> Column:
    """The invoices of a row, as an array without nulls."""
    return F.col("Invoices") if "Lines" in df.columns else F.array_compact(F.array("Invoice_No"))


def counted(df: DataFrame, kinds: dict[str, Column], when: Column | None = None) -> Column:
    """A row's contributions to distinct counts: an array of (kind, id), where a kind's column is one value or an array."""
    def named(kind: str, c: Column) -> Column:
        ids = c if kind == "invoice" else F.array_compact(F.array(c))
        return F.transform(ids, lambda x: F.struct(F.lit(kind).alias("_kind"), x.cast("string").alias("_id")))

    every = F.concat(*[named(kind, c) for kind, c in kinds.items()])
    return every if when is None else F.when(when, every).otherwise(F.filter(every, lambda _: F.lit(False)))
