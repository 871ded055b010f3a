"""Explicit schemas of the four tables (fixed StructTypes, validated on read; extra columns allowed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

SALES = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Month_and_Year", T.StringType()),
    T.StructField("Month_and_Year_Sort", T.IntegerType()),
    T.StructField("Invoice_Date", T.DateType()),
    T.StructField("Invoice_No", T.LongType()),
    T.StructField("Invoice_Type", T.StringType()),
    T.StructField("Item_Code", T.StringType()),
    T.StructField("Item_Desc", T.StringType()),
    T.StructField("Regular_Qty", T.LongType()),
    T.StructField("Bonus_Qty", T.LongType()),
    T.StructField("Amount", MONEY),
    T.StructField("Brand", T.StringType()),
    T.StructField("Brand_Mask", T.StringType()),
    T.StructField("Salesman", T.StringType()),
    T.StructField("Manager", T.StringType()),
    T.StructField("GM", T.StringType()),
    T.StructField("Customer_Name", T.StringType()),
    T.StructField("Group", T.StringType()),
    T.StructField("Emirate", T.StringType()),
    T.StructField("Channel", T.StringType()),
])

TARGET = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Month_and_Year", T.StringType()),
    T.StructField("Month_and_Year_Sort", T.IntegerType()),
    T.StructField("Brand", T.StringType()),
    T.StructField("Salesman", T.StringType()),
    T.StructField("Manager", T.StringType()),
    T.StructField("GM", T.StringType()),
    T.StructField("Emirate", T.StringType()),
    T.StructField("Channel", T.StringType()),
    T.StructField("Customer_Name", T.StringType()),
    T.StructField("Target", MONEY),
])

# Grouping keys of the two pre-aggregated marts (fixed values).
SALES_SUMMARY_KEYS = [
    "Year", "Month_and_Year", "Month_and_Year_Sort", "Brand", "Salesman", "Manager", "GM", "Emirate", "Channel",
    "Customer_Name",
]
TARGET_SUMMARY_KEYS = [
    "Month_and_Year", "Month_and_Year_Sort", "Brand", "Salesman", "Manager", "GM", "Emirate", "Channel",
    "Customer_Name",
]
# Join keys of sales_summary -> target_summary (fixed values).
TARGET_JOIN_KEYS = ["Brand", "Salesman", "Month_and_Year", "Customer_Name"]


class SchemaError(ValueError):
    pass


def validate(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Check that every declared column exists with the declared type; cast where only widening is needed."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")
    out = df
    for f in schema.fields:
        if have[f.name] != f.dataType:
            out = out.withColumn(f.name, out[f"`{f.name}`"].cast(f.dataType))
    return out
