"""Integrated reports: item health check (H1) and brand supply-chain dashboard.

Both are joins of the other operators' outputs on their entity key; the parts are computed
set-based for every item / brand and nested only where the nesting is bounded (3 coverage
windows and one row per channel per item). Per-brand detail lists are returned as separate
DataFrames rather than collected into one row, since a brand's lists grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import dates
from salescope.functions.expr import money
from salescope.operators import coverage, patterns, stock
from salescope.session import kept

HEALTH_WINDOWS = (12, 24, 36)
HEALTH_MONTHS = max(HEALTH_WINDOWS)  # what the health report reads
DASHBOARD_MONTHS = 24  # what the dashboard reads


def item_health(sales: DataFrame, *, as_of, item_code: str | None = None, days_threshold: int = 30, items: DataFrame | None = None) -> DataFrame:
    """H1: for every item ever sold 12-month basics + coverage (12/24/36) + 12-month pattern + OOS row + channels.

    ``sales`` is the fact or its ``item_days`` rollup, ``items`` the items ever sold (without it ``sales`` lists them). An item without a sale in the last year has no description, sales or last date, and no customer.

    The coverage, the patterns and the out-of-stock rows are written one after another before the report is put together
    with the rest: one part's shuffle files lie on disk at a time.
    """
    df = sales if item_code is None else sales.filter(F.col("Item_Code") == F.lit(item_code))
    basic = dates.since(df, dates.months_ago(as_of, 12)).groupBy("Item_Code").agg(
        F.max(F.struct("Invoice_Date", "Item_Desc", "Brand")).alias("_last"),
        money(F.sum("Amount")).alias("total_sales_12m"),
        F.countDistinct("Customer_Name").alias("customer_count"),
        F.max("Invoice_Date").alias("last_sale_date"),
    )
    cov = coverage.coverage_windows(df, as_of=as_of, level="item", entity=None, time_windows=HEALTH_WINDOWS)
    none = F.array(*[F.struct(F.lit(m).alias("Months"), F.lit(f"{m}M").alias("Time_Window"), F.lit(0).cast("bigint").alias("Coverage_Count"),
                              F.lit(None).cast("double").alias("Total_Sales"), F.lit(0).cast("bigint").alias("Transaction_Count"))
                     for m in HEALTH_WINDOWS])
    cov = cov.groupBy("Item_Code").agg(F.array_sort(F.collect_list(F.struct(
        "Months", "Time_Window", "Coverage_Count", "Total_Sales", "Transaction_Count"))).alias("coverage"))
    cov = kept(cov)
    pat = patterns.item_pattern(df, as_of=as_of, months=12, item_code=item_code, items=items)
    pat = kept(pat.select("Item_Code", F.struct(*[c for c in pat.columns if c != "Item_Code"]).alias("pattern")))
    # The all-brand OOS report, first row per item (by historical sales) as in a records lookup.
    oos = stock.oos_items(sales, as_of=as_of, days_threshold=days_threshold, ordered=False)
    w = Window.partitionBy("Item_Code").orderBy(F.col("Historical_Sales").desc(), F.col("Item_Desc"))
    oos = (oos.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
           .select("Item_Code", F.struct(*[c for c in oos.columns if c != "Item_Code"]).alias("oos_risk")))
    oos = kept(oos)
    ch = stock.channel_oos(df, as_of=as_of, days_threshold=days_threshold)
    ch = ch.groupBy("Item_Code").agg(F.array_sort(F.collect_list(
        F.struct(*[c for c in ch.columns if c != "Item_Code"]))).alias("channel_distribution"))
    # The patterns list every item.
    out = pat.join(basic, "Item_Code", "left").join(cov, "Item_Code", "left").join(
        oos, "Item_Code", "left").join(ch, "Item_Code", "left")
    return out.select(
        F.col("Item_Code").alias("item_code"),
        F.col("_last.Item_Desc").alias("item_desc"),
        F.col("_last.Brand").alias("brand"),
        "total_sales_12m", F.coalesce("customer_count", F.lit(0).cast("bigint")).alias("customer_count"), "last_sale_date",
        F.coalesce("coverage", none).alias("coverage"), "pattern", "oos_risk",
        F.coalesce(F.col("channel_distribution"),
                   F.array().cast(ch.schema["channel_distribution"].dataType)).alias("channel_distribution"),
    )


def health_columns(health: DataFrame) -> DataFrame:
    """The nested health report as one flat row per item: reach per window, pattern, risk and channel counts."""
    reach = [F.col("coverage")[i]["Coverage_Count"].alias(f"coverage_{m}m") for i, m in enumerate(HEALTH_WINDOWS)]
    return health.select(
        "item_code", "item_desc", "brand", "total_sales_12m", "customer_count", "last_sale_date", *reach,
        F.col("coverage")[2]["Total_Sales"].alias("sales_36m"), "pattern.pattern", "pattern.planning_implication", "pattern.months_present",
        F.col("oos_risk.OOS_Risk_Level").alias("oos_level"), F.col("oos_risk.Historical_Sales").alias("oos_historical_sales"),
        F.size("channel_distribution").cast("bigint").alias("channels"),
        F.size(F.filter("channel_distribution", lambda c: c["OOS_Risk"])).cast("bigint").alias("channels_at_risk"))


def supply_chain_parts(sales: DataFrame, *, as_of, brand: str, days_threshold: int = 30) -> dict[str, DataFrame]:
    """H2 detail for one brand: the five lists, each a DataFrame."""
    return {
        "oos_items": stock.oos_items(sales, as_of=as_of, brand=brand, days_threshold=days_threshold),
        "supply_issues": stock.multi_account_oos(sales, as_of=as_of, brand=brand, min_accounts=5,
                                                 days_threshold=days_threshold),
        "coverage_loss": coverage.coverage_loss(sales, as_of=as_of, entity=brand, entity_type="Brand",
                                                recent_months=12, historical_months=24),
        "seasonal_items": patterns.seasonal_items(sales, as_of=as_of, brand=brand, min_sales=50000, months=24),
        "anomalies": patterns.anomalies(sales, as_of=as_of, brand=brand, months=12),
    }


def supply_chain_dashboard(sales: DataFrame, *, as_of, brand: str | None = None, days_threshold: int = 30,
                           cards: tuple[str, ...] | None = None, items: DataFrame | None = None) -> DataFrame:
    """Per brand the counts of the five lists (every brand at once when ``brand`` is None).

    ``sales`` is the fact or its ``item_days`` rollup, ``items`` lists the brands ever sold (without it ``sales`` does).

    Each list is computed per brand in one job (brand-filtered semantics for every brand) and
    counted by brand; the counts are joined onto the brand list. The counts of all lists but the last are written one
    after another, so that neither the plans nor the shuffle files of all lists are held at a time.
    """
    src = sales if brand is None else sales.filter(F.col("Brand") == F.lit(brand))
    parts = {
        "oos_items": stock.oos_items(src, as_of=as_of, days_threshold=days_threshold, per_brand=True,
                                     ordered=False),
        "supply_issues": stock.multi_account_oos(sales, as_of=as_of, brand=brand, min_accounts=5,
                                                 days_threshold=days_threshold, ordered=False),
        "coverage_loss": coverage.lost_members(src, as_of=as_of, entity=None, entity_type="Brand",
                                               recent_months=12, historical_months=DASHBOARD_MONTHS),
        "seasonal_items": patterns.seasonal_items(sales, as_of=as_of, brand=brand, min_sales=50000, months=DASHBOARD_MONTHS,
                                                  ordered=False),
        "anomalies": patterns.anomalies(src, as_of=as_of, months=12, per_brand=True),
    }
    names = cards or tuple(parts)
    listed = src if items is None else items if brand is None else items.filter(F.col("Brand") == F.lit(brand))
    out = listed.filter(F.col("Brand").isNotNull()).select("Brand").distinct()
    for name in names:
        counts = parts[name].groupBy("Brand").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = out.join(counts if name == names[-1] else kept(counts), "Brand", "left")
    return out.select(F.col("Brand").alias("brand"),
                      *[F.coalesce(F.col(f"{n}_count"), F.lit(0)).cast("bigint").alias(f"{n}_count") for n in names])
