"""Pre-aggregated marts (the reference's summary tables), built once and written by the caller.

``sales_summary``: 10 keys -> Total_Amount, Total_Qty, Total_Bonus, Transaction_Count (line count).
``target_summary``: 9 keys -> Total_Target, and the Year its month label ends with, by which it is
stored and pruned. Both are plain ``groupBy().agg()`` jobs: partial
aggregation map-side, one shuffle on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.sources.schema import SALES_SUMMARY_KEYS, TARGET_SUMMARY_KEYS


def sales_summary(sales: DataFrame) -> DataFrame:
    return sales.groupBy(*SALES_SUMMARY_KEYS).agg(
        F.sum("Amount").alias("Total_Amount"),
        F.sum("Regular_Qty").alias("Total_Qty"),
        F.sum("Bonus_Qty").alias("Total_Bonus"),
        F.count(F.lit(1)).alias("Transaction_Count"),
    )


def target_summary(target: DataFrame) -> DataFrame:
    summed = target.groupBy(*TARGET_SUMMARY_KEYS).agg(F.sum("Target").alias("Total_Target"))
    return summed.withColumn("Year", F.expr("try_cast(right(Month_and_Year, 4) AS INT)"))
