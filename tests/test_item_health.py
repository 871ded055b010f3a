"""The nested item health report (rows-only in the gate) is consistent with its standalone parts."""

import datetime as dt

from pyspark.sql import functions as F

from salescope.operators import coverage, integrated, patterns, stock

AS_OF = dt.date(2001, 8, 1)


def test_item_health_parts_match_standalone_operators(spark, tables):
    health = {r["item_code"]: r for r in integrated.item_health(tables.sales, as_of=AS_OF).collect()}
    basic = tables.sales.filter(F.col("Invoice_Date") >= F.add_months(F.lit(AS_OF), -12)).groupBy("Item_Code").agg(
        F.sum("Amount").cast("double").alias("s"), F.countDistinct("Customer_Name").alias("c"),
        F.max("Invoice_Date").alias("d"))
    basic = {r["Item_Code"]: r for r in basic.collect()}
    assert set(basic) < set(health) == {r["Item_Code"] for r in tables.sales.select("Item_Code").distinct().collect()}

    pat = {r["Item_Code"]: r.asDict() for r in patterns.item_pattern(tables.sales, as_of=AS_OF, months=12).collect()}
    cov = {}
    for r in coverage.coverage_windows(tables.sales, as_of=AS_OF, level="item", time_windows=(12, 24, 36)).collect():
        cov.setdefault(r["Item_Code"], {})[r["Months"]] = r["Coverage_Count"]
    oos = {r["Item_Code"]: r for r in stock.oos_items(tables.sales, as_of=AS_OF, ordered=False).collect()}
    ch = {}
    for r in stock.channel_oos(tables.sales, as_of=AS_OF).collect():
        ch.setdefault(r["Item_Code"], set()).add((r["Channel"], r["Recent_Sales"], r["Historical_Sales"]))

    for code, h in health.items():
        b = basic.get(code, {"s": None, "c": 0, "d": None})
        assert (h["total_sales_12m"], h["customer_count"], h["last_sale_date"]) == (b["s"], b["c"], b["d"])
        assert h["pattern"].asDict() == {k: v for k, v in pat[code].items() if k != "Item_Code"}
        assert {c["Months"]: c["Coverage_Count"] for c in h["coverage"]} == cov.get(code, {12: 0, 24: 0, 36: 0})
        assert (h["oos_risk"] is None) == (code not in oos)
        if code in oos:
            assert h["oos_risk"]["Historical_Sales"] == oos[code]["Historical_Sales"]
        assert {(c["Channel"], c["Recent_Sales"], c["Historical_Sales"]) for c in h["channel_distribution"]} == \
            ch.get(code, set())
