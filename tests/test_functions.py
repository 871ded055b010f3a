"""Scalar helpers: formatting, month ordinals, IEEE rounding, guarded division."""

from pyspark.sql import functions as F

from salescope.functions.expr import money_text, month_number, pct_text, safe_div, thousands
from salescope.functions.series import round_half_up


def test_formatting_and_helpers(spark):
    df = spark.createDataFrame([(1234567.891, 12.345, "Mar"), (None, None, "Dec")], "v double, p double, m string")
    r = df.select(thousands(F.col("v")).alias("t"), pct_text(F.col("p")).alias("pc"), money_text(F.col("v")).alias("mt"),
                  month_number(F.col("m")).alias("mn"), round_half_up(F.col("p"), 2).alias("rh"),
                  safe_div(F.col("v"), F.lit(0)).alias("z")).collect()
    assert (r[0]["t"], r[0]["pc"], r[0]["mt"], r[0]["mn"]) == ("1,234,568", "12.35%", "AED 1,234,567.89", 3)
    assert r[0]["rh"] == 12.35 and r[0]["z"] is None
    assert (r[1]["pc"], r[1]["mn"]) == ("N/A", 12)
