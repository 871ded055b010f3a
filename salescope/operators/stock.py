"""Out-of-stock inference.

All operators run for every item at once (the reference's per-item SQL loops become one
grouped job). Each reads the fact once, with the rolling windows expressed as conditional
aggregates over a single pushed-down date range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from salescope.functions import dates
from salescope.functions.expr import avg_of, money, sum_when
from salescope.functions.series import round_half_up
from salescope.sources import rollups

ITEM_KEYS = ["Item_Code", "Item_Desc", "Brand"]

# Risk labels and forecast suggestions of the OOS report, and the 0.3 factor.
RISK_HIGH, RISK_MEDIUM, RISK_LOW = "High", "Medium", "Low"
SUGGEST_HIGH = "Increase forecast by 20% to recover lost sales"
SUGGEST_MEDIUM = "Review stock levels and pending orders"
SUGGEST_LOW = "Monitor closely"
LOW_SALES_FACTOR = 0.3

# Decline-cause labels.
CAUSE_SUPPLY_ZERO = "Supply-Driven (High Probability OOS) - Sudden zero sales"
CAUSE_SUPPLY_WIDE = "Supply-Driven (Widespread Stoppage) - All accounts stopped buying"
CAUSE_DEMAND = "Demand-Driven (Declining Trend) - Sales dropped but not zero"
CAUSE_INCONCLUSIVE = "Inconclusive - Needs manual check"


def _brand(df: DataFrame, brand: str | None) -> DataFrame:
    return df if not brand else df.filter(F.col("Brand") == F.lit(brand))


def oos_items(sales: DataFrame, *, as_of, brand: str | None = None, days_threshold: int = 30,
              min_historical_sales: float = 10000, per_brand: bool = False, ordered: bool = True) -> DataFrame:
    """O1: items whose sales in the last ``days_threshold`` days fell below 0.3 x their average line.

    History = [as_of - 12 months, as_of - days); recent = [as_of - days, ...). ``sales`` is the fact or its
    ``item_days`` rollup, read once. A row counts for the totals of its (code, desc, brand) and for its customer,
    who may be null, and for its invoices, all in one aggregate, so the distinct counts need no expansion; a second one
    brings them together.
    Recent sales belong to the item whatever its description, so an item with two recent descriptions fans out: a
    window over the item gathers these few pairs. ``per_brand`` gathers them for the item and the brand, which gives
    every brand's brand-filtered result in one job.
    """
    c12 = dates.months_ago(as_of, 12)
    cd = dates.days_ago(as_of, days_threshold)
    d = F.col("Invoice_Date")
    is_hist = (d >= c12) & (d < cd)
    df = dates.since(_brand(sales, brand), F.least(c12, cd))
    own = F.struct(F.when(is_hist, F.lit("customer")).otherwise(F.lit("recent")).alias("_kind"),
                   F.when(is_hist, F.col("Customer_Name").cast("string")).otherwise(F.lit("")).alias("_id"))
    kinds = F.concat(F.array(own), rollups.counted(df, {"invoice": rollups.invoices(df)}, is_hist))
    each = df.select(*ITEM_KEYS, d.alias("_d"), "Amount", "Regular_Qty", rollups.lines(df).alias("_lines"),
                     rollups.priced_lines(df).alias("_priced"), F.explode(kinds).alias("_k")).select(
        *ITEM_KEYS, "_d", "Amount", "Regular_Qty", "_lines", "_priced", "_k.*")
    total = F.col("_kind") != "invoice"
    now, then = total & (F.col("_d") >= cd), total & (F.col("_d") >= c12) & (F.col("_d") < cd)
    sums = {"_n_recent": (now, "_lines"), "_recent_sales": (now, "Amount"), "_n_hist": (then, "_lines"), "_hist_sales": (then, "Amount"),
            "_priced_hist": (then, "_priced"), "Historical_Qty": (then, "Regular_Qty")}
    per = each.groupBy(*ITEM_KEYS, "_kind", "_id").agg(
        *[F.sum(F.when(cond, F.col(c))).alias(name) for name, (cond, c) in sums.items()], F.max(F.when(now, F.col("_d"))).alias("_last_sale"))
    g = per.groupBy(*ITEM_KEYS).agg(
        *[F.sum(name).alias(name) for name in sums], F.max("_last_sale").alias("_last_sale"),
        F.count(F.when((F.col("_kind") == "customer") & F.col("_id").isNotNull(), 1)).alias("Affected_Accounts"),
        F.count(F.when(F.col("_kind") == "invoice", 1)).alias("Historical_Transactions"))
    on = ["Item_Code", "Brand"] if per_brand else ["Item_Code"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    recent = F.collect_list(F.when((F.col("_n_recent") > 0) & known, F.struct("_recent_sales", "_last_sale")))
    hist = g.select("*", recent.over(Window.partitionBy(*on)).alias("_recent")).filter(
        (F.col("_n_hist") > 0) & (F.col("_hist_sales") > F.lit(min_historical_sales)))
    j = hist.drop("_recent_sales", "_last_sale").select(
        "*", F.try_divide(F.col("_hist_sales").cast("double"), F.col("_priced_hist").cast("double")).alias("Avg_Monthly_Sales"),
        F.explode_outer("_recent").alias("_r")).select("*", "_r.*")
    recent_sales = F.coalesce(money("_recent_sales"), F.lit(0.0))
    low = recent_sales < F.col("Avg_Monthly_Sales") * F.lit(LOW_SALES_FACTOR)
    zero = recent_sales == F.lit(0.0)
    out = (
        j.filter(low)
        .select(
            *ITEM_KEYS,
            money("_hist_sales").alias("Historical_Sales"),
            "Affected_Accounts",
            "Historical_Transactions",
            "Avg_Monthly_Sales",
            "Historical_Qty",
            recent_sales.alias("Recent_Sales"),
            F.col("_last_sale").alias("Last_Sale_Date"),
            F.datediff(dates.as_date(as_of), F.coalesce(F.col("_last_sale"), cd)).alias("Days_Since_Sale"),
            F.when(zero, RISK_HIGH).when(low, RISK_MEDIUM).otherwise(RISK_LOW).alias("OOS_Risk_Level"),
            F.when(zero, SUGGEST_HIGH).when(low, SUGGEST_MEDIUM).otherwise(SUGGEST_LOW).alias("Forecast_Suggestion"),
        )
    )
    return out.orderBy(F.col("Historical_Sales").desc(), F.col("Item_Code"), F.col("Item_Desc")) if ordered else out


def _items(listed: DataFrame, item_code: str | None) -> DataFrame:
    rows = listed if item_code is None else listed.filter(F.col("Item_Code") == F.lit(item_code))
    return rows.select("Item_Code").distinct()


def decline_cause(sales: DataFrame, *, as_of, item_code: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """O2: Supply-driven / demand-driven / inconclusive per item (last 30 days vs days 30-90).

    ``items`` lists the items ever sold (the dimension); without it ``sales`` does."""
    c30 = dates.days_ago(as_of, 30)
    c90 = dates.days_ago(as_of, 90)
    d = F.col("Invoice_Date")
    df = sales if item_code is None else sales.filter(F.col("Item_Code") == F.lit(item_code))
    # Every item ever sold gets a verdict; only the last 90 days need measures, which come from the pruned 90-day
    # slice via per-customer flags (no multi-distinct expansion). Both sides are partitioned by Item_Code for the join.
    listed = _items(sales if items is None else items, item_code)
    per_cust = dates.since(df, c90).groupBy("Item_Code", "Customer_Name").agg(
        F.sum(F.when(d >= c30, F.col("Amount"))).alias("_r"),
        F.sum(F.when(d < c30, F.col("Amount"))).alias("_h"),
        F.max(F.when(d >= c30, 1)).alias("_rc"),
        F.max(F.when(d < c30, 1)).alias("_hc"),
    )
    recent = per_cust.groupBy("Item_Code").agg(
        F.sum("_r").alias("_rs"), F.sum("_h").alias("_hs"),
        F.count(F.when(F.col("Customer_Name").isNotNull() & (F.col("_rc") == 1), 1)).alias("rc"),
        F.count(F.when(F.col("Customer_Name").isNotNull() & (F.col("_hc") == 1), 1)).alias("hc"),
    )
    g = listed.join(recent, "Item_Code", "left").select(
        "Item_Code",
        F.coalesce(F.col("_rs"), F.lit(0)).alias("rs"), F.coalesce(F.col("_hs"), F.lit(0)).alias("hs"),
        F.coalesce(F.col("rc"), F.lit(0)).alias("rc"), F.coalesce(F.col("hc"), F.lit(0)).alias("hc"))
    rs, hs = F.col("rs"), F.col("hs")
    cause = (
        F.when((hs > 1000) & (rs == 0), CAUSE_SUPPLY_ZERO)
        .when((F.col("hc") > 5) & (F.col("rc") == 0), CAUSE_SUPPLY_WIDE)
        .when((hs > 0) & (rs * 2 < hs) & (rs > 0), CAUSE_DEMAND)
        .otherwise(CAUSE_INCONCLUSIVE)
    )
    return g.select(F.col("Item_Code").alias("Item"), cause.alias("Cause"))


def channel_oos(sales: DataFrame, *, as_of, item_code: str | None = None, days_threshold: int = 30) -> DataFrame:
    """O3: per (item, channel) recent vs historical sales and customers, local-OOS flag, drop %."""
    c12 = dates.months_ago(as_of, 12)
    cd = dates.days_ago(as_of, days_threshold)
    d = F.col("Invoice_Date")
    is_recent = d >= cd
    is_hist = (d >= c12) & (d < cd)
    df = sales if item_code is None else sales.filter(F.col("Item_Code") == F.lit(item_code))
    g = (
        dates.since(df, F.least(c12, cd))
        .groupBy("Item_Code", "Channel")
        .agg(
            sum_when(is_recent, "Amount").alias("rs"),
            sum_when(is_hist, "Amount").alias("hs"),
            F.countDistinct(F.when(is_recent, F.col("Customer_Name"))).alias("Recent_Customers"),
            F.countDistinct(F.when(is_hist, F.col("Customer_Name"))).alias("Historical_Customers"),
        )
        .filter(F.col("hs") > 0)
    )
    drop = (money("hs") - money("rs")) / money("hs") * F.lit(100.0)
    return g.select(
        "Item_Code", "Channel",
        money("rs").alias("Recent_Sales"),
        money("hs").alias("Historical_Sales"),
        "Recent_Customers", "Historical_Customers",
        ((F.col("hs") > 0) & (F.col("rs") == 0)).alias("OOS_Risk"),
        round_half_up(drop, 2).alias("Sales_Drop_Pct"),
    )


def multi_account_oos(sales: DataFrame, *, as_of, brand: str | None = None, min_accounts: int = 5,
                      days_threshold: int = 30, ordered: bool = True) -> DataFrame:
    """Items where at least ``min_accounts`` accounts last bought more than ``days`` days ago.

    The reference re-joins the 12-month fact on (Item_Code, Customer_Name); summing that join
    equals summing, per stopped account row, the account's 12-month total for the item code, which
    a window over the already-aggregated rows gives without touching the fact again.
    """
    c12 = dates.months_ago(as_of, 12)
    cd = dates.days_ago(as_of, days_threshold)
    per_acct = (
        dates.since(sales, c12)
        .groupBy(*ITEM_KEYS, "Customer_Name")
        .agg(F.max("Invoice_Date").alias("Last_Purchase"), F.sum("Amount").alias("_amt"))
    )
    # The re-join is over all 12-month rows of (code, customer), brand filter or not.
    code_cust = Window.partitionBy("Item_Code", "Customer_Name")
    stopped = (
        per_acct.withColumn("_code_cust_amt", F.sum("_amt").over(code_cust))
        .filter(F.col("Last_Purchase") < cd)
    )
    stopped = _brand(stopped, brand)
    out = (
        stopped.groupBy(*ITEM_KEYS)
        .agg(
            F.countDistinct("Customer_Name").alias("Stopped_Accounts"),
            F.max("Last_Purchase").alias("Most_Recent_Stop"),
            money(F.sum("_code_cust_amt")).alias("Lost_Sales_Potential"),
        )
        .filter(F.col("Stopped_Accounts") >= min_accounts)
    )
    if not ordered:
        return out
    return out.orderBy(F.col("Stopped_Accounts").desc(), F.col("Lost_Sales_Potential").desc(), F.col("Item_Code"))


def oos_impact(sales: DataFrame, *, as_of, oos_days: int = 30, item_code: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Mean (day, customer) sales x days, affected customers, 12-month sales, for every item ever sold."""
    c12 = dates.months_ago(as_of, 12)
    df = sales if item_code is None else sales.filter(F.col("Item_Code") == F.lit(item_code))
    daily = (
        dates.since(df, c12)
        .groupBy("Item_Code", "Invoice_Date", "Customer_Name")
        .agg(F.sum("Amount").alias("daily_sales"))
    )
    figures = daily.groupBy("Item_Code").agg(
        (avg_of(F.col("daily_sales")) * F.lit(float(oos_days))).alias("Estimated_Lost_Sales"),
        F.countDistinct("Customer_Name").alias("Affected_Customers"),
        money(F.sum("daily_sales")).alias("Annual_Sales"),
    )
    # Items silent for a year are the ones in question: they stay, without an estimate.
    return _items(sales if items is None else items, item_code).join(figures, "Item_Code", "left").withColumn(
        "Affected_Customers", F.coalesce("Affected_Customers", F.lit(0).cast("bigint")))
