"""Run-rate and pattern detection (R1-R5), for every item (or entity) at once.

A monthly series is ``groupBy(entity, yyyy-MM)`` over the window; series are positional over the
months present (gaps are not zero-filled). Per entity, the series is at most ``months`` points,
so the per-entity ``collect_list`` that gives positional access (first-k / last-k slices, trend
index) is bounded by the window length, not by the data. Every statistic comes from exact
DECIMAL sums (see :mod:`salescope.functions.series`); there is no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import dates
from salescope.functions.expr import money
from salescope.functions.series import (WIDE, mean, pearson, round_half_up, std_pop, trend_threshold,
                                        TREND_MIN_POINTS)

# Pattern labels, planning implications, thresholds and seasonal lags.
INSUFFICIENT = "Insufficient Data"
SPIKE, DROP = "Strange (Spike)", "Strange (Drop)"
SEASONAL, STABLE, FLUCTUATING, MODERATE = "Seasonal", "Stable", "Fluctuating", "Moderate Variation"
IMPL_INSUFFICIENT = "Need more history for analysis."
DETAILS_INSUFFICIENT = "Need at least 3 months of data"
IMPL_STABLE = "Predictable demand. Automate replenishment."
IMPL_SEASONAL = "Stock up 2 months prior to peak ({})."
IMPL_FLUCTUATING = "Maintain higher safety stock to buffer volatility."
IMPL_STRANGE = "Investigate cause (Promo? OOS?). Exclude from forecast."
IMPL_OTHER = "Monitor variance."
MIN_POINTS = 3
SEASONAL_MIN_POINTS = 12
SEASONAL_LAGS = (3, 6, 12)
SEASONAL_MIN_R = 0.7
Z_THRESHOLD = 2.5
CV_STABLE, CV_FLUCTUATING = 0.2, 0.5
STABILITY_BANDS = [(0.15, "Very Stable"), (0.30, "Stable"), (0.50, "Moderate")]
STABILITY_ELSE = "Unstable"


def monthly(sales: DataFrame, *, as_of, months: int, keys: list[str], with_details: bool = False) -> DataFrame:
    """Per (keys, Month='yyyy-MM') Sales [, Quantity, distinct Customers] over the last ``months``."""
    aggs = [F.sum("Amount").alias("Sales")]
    if with_details:
        aggs += [F.sum("Regular_Qty").alias("Quantity"), F.countDistinct("Customer_Name").alias("Customers")]
    return (dates.since(sales, dates.months_ago(as_of, months))
            .groupBy(*keys, dates.year_month().alias("Month")).agg(*aggs))


def _z(x: Column, m: Column, s: Column) -> Column:
    return F.try_divide(F.abs(x.cast("double") - m), s)


def _item_sums(series: DataFrame) -> DataFrame:
    """Per item: n, exact sums, and every positional sum the pattern rules need, as aggregates.

    Stage 1 collects each item's (Month, Sales) points in month order (at most ``months`` points).
    Stage 2 explodes them with their position and aggregates again by item; the data is already
    hash-partitioned by Item_Code, so this second aggregate adds no shuffle. Keeping the sums as
    aggregate outputs also stops later filters (e.g. "is seasonal") from being pushed below them
    and re-evaluating them.
    """
    per = series.groupBy("Item_Code").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("Sales").alias("sx"),
        F.sum(F.col("Sales") * F.col("Sales")).alias("sxx"),
        F.array_sort(F.collect_list(F.struct("Month", "Sales"))).alias("_pts"),
    )
    n, pts = F.col("n"), F.col("_pts")

    def point(p, i):  # each point with its position and, for the first ``lag`` points, its lag partner
        partners = [F.when((i < lag) & (n >= 2 * lag), F.element_at(pts, (i + n - lag + 1).cast("int"))["Sales"])
                    .alias(f"p{lag}") for lag in SEASONAL_LAGS]
        return F.struct(i.alias("pos"), p["Month"].alias("Month"), p["Sales"].alias("Sales"), *partners)

    pe = per.select("Item_Code", "n", "sx", "sxx", F.explode(F.transform(pts, point)).alias("pt"))
    x, pos = F.col("pt.Sales"), F.col("pt.pos")
    m, s = mean(n, F.col("sx")), std_pop(n, F.col("sx"), F.col("sxx"))
    anom = F.coalesce(_z(x, m, s) > Z_THRESHOLD, F.lit(False))
    aggs = []
    for lag in SEASONAL_LAGS:
        first = pos < lag
        last = pos >= n - lag
        partner = F.col(f"pt.p{lag}")
        aggs += [F.sum(F.when(first, x)).alias(f"_l{lag}_0"), F.sum(F.when(last, x)).alias(f"_l{lag}_1"),
                 F.sum(F.when(first, x * x)).alias(f"_l{lag}_2"), F.sum(F.when(last, x * x)).alias(f"_l{lag}_3"),
                 F.sum(x * partner).alias(f"_l{lag}_4")]
    mm = F.month(F.to_date(F.concat(F.col("pt.Month"), F.lit("-01"))))
    for k in range(1, 13):
        aggs += [F.sum(F.when(mm == k, x)).alias(f"_m{k}_s"), F.count(F.when(mm == k, 1)).alias(f"_m{k}_n")]
    aggs += [F.sum(x * pos).alias("_six"), F.count(F.when(anom, 1)).alias("_k"), F.sum(F.when(anom, x)).alias("_anom_sum")]
    return pe.groupBy("Item_Code", "n", "sx", "sxx").agg(*aggs)


def _lag_r(lag: int) -> Column:
    s = [F.coalesce(F.col(f"_l{lag}_{i}"), F.lit(0)) for i in range(5)]
    return pearson(F.lit(lag), *s)


def _peaks(top: int = 3) -> Column:
    """Top calendar months ('MM') by mean monthly sales (ties by month), from the 12 month sums."""
    months = F.array(*[F.struct(
        (-F.try_divide(F.col(f"_m{k}_s").cast("double"), F.col(f"_m{k}_n").cast("double"))).alias("neg_avg"),
        F.lit(f"{k:02d}").alias("mm"), F.col(f"_m{k}_n").alias("cnt")) for k in range(1, 13)])
    present = F.filter(months, lambda e: e["cnt"] > 0)
    return F.transform(F.slice(F.array_sort(F.transform(present, lambda e: F.struct(e["neg_avg"], e["mm"]))), 1, top),
                       lambda e: e["mm"])


def _with_silent(found: DataFrame, entities: DataFrame, key: str, defaults: dict) -> DataFrame:
    """``found`` and a row for every one of ``entities`` without a month in the window, with ``defaults``."""
    listed = entities.select(key).filter(F.col(key).isNotNull()).distinct().join(found, key, "left")
    return listed.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in found.columns])


def item_pattern(sales: DataFrame, *, as_of, months: int = 12, item_code: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Pattern class and metrics for every item (positional monthly series over ``months``); an item
    without a month in the window has insufficient data. ``items`` lists the items ever sold (the dimension); without
    it ``sales`` does."""
    one = lambda rows: rows if item_code is None else rows.filter(F.col("Item_Code") == F.lit(item_code))
    df = one(sales)
    found = _with_silent(_active_patterns(df, as_of=as_of, months=months), df if items is None else one(items), "Item_Code", {
        "months_present": 0, "pattern": INSUFFICIENT, "planning_implication": IMPL_INSUFFICIENT, "is_seasonal": False,
        "has_anomalies": False, "peak_months": ""})
    few = F.col("pattern") == INSUFFICIENT
    return found.withColumns({"confidence": F.when(few, F.lit(0)), "details": F.when(few, F.lit(DETAILS_INSUFFICIENT))})


def _active_patterns(df: DataFrame, *, as_of, months: int) -> DataFrame:
    """R1 for the items that have a month in the window."""
    return _patterns_of(monthly(df, as_of=as_of, months=months, keys=["Item_Code"]))


def _patterns_of(series: DataFrame) -> DataFrame:
    """R1 from the monthly sums (Item_Code, Month, Sales)."""
    st = _item_sums(series)
    n = F.col("n")
    m, s = mean(n, F.col("sx")), std_pop(n, F.col("sx"), F.col("sxx"))

    # Seasonality: first of lags 3, 6, 12 with enough points and r(first lag, last lag) > 0.7.
    seasonal_lag = F.lit(None).cast("int")
    for lag in reversed(SEASONAL_LAGS):
        hit = (n >= SEASONAL_MIN_POINTS) & (n >= 2 * lag) & F.coalesce(_lag_r(lag) > SEASONAL_MIN_R, F.lit(False))
        seasonal_lag = F.when(hit, F.lit(lag)).otherwise(seasonal_lag)

    # Trend: r of (index, value) with |r| > max(0.7, rcrit(n)), n >= 6; direction from the slope sign.
    idx_sum = F.expr("CAST(n * (n - 1) div 2 AS DECIMAL(20,0))")
    idx_sq = F.expr("CAST((n - 1) * n * (2 * n - 1) div 6 AS DECIMAL(20,0))")
    six = F.col("_six")
    r_trend = pearson(n, idx_sum, F.col("sx"), idx_sq, F.col("sxx"), six)
    slope_num = (n.cast("decimal(20,0)") * six.cast(WIDE) - idx_sum * F.col("sx").cast(WIDE)).cast(WIDE)

    cv = F.when(m > 0, F.try_divide(s, m)).otherwise(F.lit(0.0))
    st = st.select(
        "Item_Code", "n", "sx", m.alias("_mean"), s.alias("_std"),
        cv.alias("_cv"), seasonal_lag.alias("seasonal_lag"), F.col("_k"),
        F.when(F.col("_k") > 0, F.col("_anom_sum")).alias("_anom_sum"),
        F.when(n >= TREND_MIN_POINTS, F.coalesce(F.abs(r_trend) > trend_threshold(n), F.lit(False)))
        .otherwise(F.lit(False)).alias("has_trend"),
        F.when(n < TREND_MIN_POINTS, F.lit("none")).when(slope_num > 0, F.lit("increasing"))
        .otherwise(F.lit("decreasing")).alias("trend_direction"),
        _peaks().alias("_peaks"),
    )
    return _classify(st)


def _classify(st: DataFrame) -> DataFrame:
    n, cv, k = F.col("n"), F.col("_cv"), F.col("_k")
    seasonal = F.col("seasonal_lag").isNotNull()
    spike = F.col("_anom_sum").cast(WIDE) * n.cast("decimal(20,0)") > k.cast("decimal(20,0)") * F.col("sx").cast(WIDE)
    pattern = (F.when(n < MIN_POINTS, INSUFFICIENT)
               .when(k > 0, F.when(spike, SPIKE).otherwise(DROP))
               .when(seasonal, SEASONAL)
               .when(cv < CV_STABLE, STABLE)
               .when(cv > CV_FLUCTUATING, FLUCTUATING)
               .otherwise(MODERATE))
    peaks = F.when(seasonal & (n >= SEASONAL_MIN_POINTS), F.col("_peaks")).otherwise(F.array().cast("array<string>"))
    first_peak = F.coalesce(F.element_at(peaks, 1), F.lit(""))
    p = F.col("pattern")
    implication = (F.when(p == INSUFFICIENT, IMPL_INSUFFICIENT)
                   .when(p == STABLE, IMPL_STABLE)
                   .when(p == SEASONAL, F.format_string(IMPL_SEASONAL.replace("{}", "%s"), first_peak))
                   .when(p == FLUCTUATING, IMPL_FLUCTUATING)
                   .when(p.startswith("Strange"), IMPL_STRANGE)
                   .otherwise(IMPL_OTHER))
    enough = n >= MIN_POINTS
    out = st.withColumn("pattern", pattern).withColumn("_peak_arr", peaks)
    return out.select(
        "Item_Code",
        n.cast("int").alias("months_present"),
        "pattern",
        implication.alias("planning_implication"),
        F.when(enough, round_half_up(cv, 3)).alias("cv"),
        (enough & seasonal).alias("is_seasonal"),
        F.when(enough, F.col("seasonal_lag")).alias("seasonal_lag"),
        (enough & (k > 0)).alias("has_anomalies"),
        F.when(enough, k).cast("int").alias("anomaly_count"),
        F.when(enough, F.col("has_trend")).alias("has_trend"),
        F.when(enough, F.col("trend_direction")).alias("trend_direction"),
        F.array_join(F.col("_peak_arr"), ", ").alias("peak_months"),
        F.when(enough, round_half_up(F.col("_mean"), 2)).alias("mean_sales"),
        F.when(enough, round_half_up(F.col("_std"), 2)).alias("std_sales"),
    )


def item_monthly_data(sales: DataFrame, *, as_of, months: int = 12, item_code: str | None = None) -> DataFrame:
    """R1g: per item and month Sales, Quantity, distinct Customers (the pattern's ``monthly_data``)."""
    df = sales if item_code is None else sales.filter(F.col("Item_Code") == F.lit(item_code))
    m = monthly(df, as_of=as_of, months=months, keys=["Item_Code"], with_details=True)
    return m.select("Item_Code", "Month", money("Sales").alias("Sales"), "Quantity", "Customers")


def seasonal_items(sales: DataFrame, *, as_of, brand: str | None = None, min_sales: float = 50000,
                   months: int = 24, ordered: bool = True) -> DataFrame:
    """R2: items above ``min_sales`` in the window whose pattern is flagged seasonal.

    Candidates are (code, desc, brand) groups (brand-filtered); the pattern is computed per
    Item_Code over all of its rows, as the reference does, for the candidates alone, and joined back once.
    One scan: the monthly sums of all groups lie by item (an item has a row for each month and description at most),
    which serves their totals, the candidates' series and the join without another shuffle.
    """
    detail = monthly(sales, as_of=as_of, months=months, keys=["Item_Code", "Item_Desc", "Brand"]).repartition("Item_Code")
    detail = detail.withColumn("_total", F.sum("Sales").over(Window.partitionBy("Item_Code", "Item_Desc", "Brand")))
    wanted = F.col("_total") > F.lit(min_sales)
    if brand:
        wanted = wanted & (F.col("Brand") == F.lit(brand))
    cand = detail.filter(wanted).groupBy("Item_Code", "Item_Desc", "Brand").agg(F.max("_total").alias("_total"))
    any_wanted = F.max(F.when(wanted, 1)).over(Window.partitionBy("Item_Code"))
    series = (detail.withColumn("_wanted", any_wanted).filter(F.col("_wanted") == 1)
              .groupBy("Item_Code", "Month").agg(F.sum("Sales").cast("decimal(28,2)").alias("Sales")))
    pat = _patterns_of(series).filter(F.col("is_seasonal"))
    out = cand.join(pat, "Item_Code").select(
        "Item_Code", "Item_Desc", "Brand", money("_total").alias("Total_Sales"),
        F.col("pattern").alias("Pattern"), F.col("peak_months").alias("Peak_Months"),
        F.col("cv").alias("CV"), F.col("seasonal_lag").alias("Seasonal_Lag"),
    )
    return out.orderBy(F.col("Total_Sales").desc(), "Item_Code", "Item_Desc") if ordered else out


def anomalies(sales: DataFrame, *, as_of, brand: str | None = None, months: int = 12, threshold: float = Z_THRESHOLD,
              per_brand: bool = False) -> DataFrame:
    """Item-months with |z| > threshold among an item's rows (>= 3 rows), Spike / Drop, deviation %.

    Rows are (code, desc, brand, month) aggregates grouped per Item_Code (per (Brand, Item_Code)
    with ``per_brand``); moments come from window sums over that partition, which holds at most
    one row per month and description.
    """
    base = sales if not brand else sales.filter(F.col("Brand") == F.lit(brand))
    rows = monthly(base, as_of=as_of, months=months, keys=["Item_Code", "Item_Desc", "Brand"])
    part = ["Brand", "Item_Code"] if per_brand else ["Item_Code"]
    w = Window.partitionBy(*part)
    rows = (rows.withColumn("n", F.count(F.lit(1)).over(w))
            .withColumn("sx", F.sum("Sales").over(w))
            .withColumn("sxx", F.sum(F.col("Sales") * F.col("Sales")).over(w))
            .withColumn("_first", F.min(F.struct("Item_Desc", "Brand")).over(w)))
    m = mean(F.col("n"), F.col("sx"))
    s = std_pop(F.col("n"), F.col("sx"), F.col("sxx"))
    z = _z(F.col("Sales"), m, s)
    x = F.col("Sales").cast("double")
    return rows.filter((F.col("n") >= MIN_POINTS) & F.coalesce(z > threshold, F.lit(False))).select(
        "Item_Code",
        F.col("_first.Item_Desc").alias("Item_Desc"),
        F.col("_first.Brand").alias("Brand"),
        "Month",
        money("Sales").alias("Sales"),
        round_half_up(z, 6).alias("Z_Score"),
        F.when(x > m, F.lit("Spike")).otherwise(F.lit("Drop")).alias("Type"),
        round_half_up(F.try_divide(x - m, m) * F.lit(100.0), 2).alias("Deviation_Pct"),
    )


def run_rate_stability(sales: DataFrame, *, as_of, entity: str | None = None, entity_type: str = "Brand",
                       months: int = 12, entities: DataFrame | None = None) -> DataFrame:
    """CV class of the monthly series of every entity; mean, std, min, max monthly sales.

    ``entities`` lists the entities (a dimension); without it ``sales`` does."""
    def known(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col(entity_type).isNotNull())
        return rows if entity is None else rows.filter(F.col(entity_type) == F.lit(entity))

    df = known(sales)
    series = monthly(df, as_of=as_of, months=months, keys=[entity_type])
    g = series.groupBy(entity_type).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Sales").alias("sx"),
        F.sum(F.col("Sales") * F.col("Sales")).alias("sxx"),
        F.min("Sales").alias("_min"), F.max("Sales").alias("_max"))
    n = F.col("n")
    m = mean(n, F.col("sx"))
    s = std_pop(n, F.col("sx"), F.col("sxx"))
    cv = F.when(m > 0, F.try_divide(s, m)).otherwise(F.lit(0.0))
    band = F.lit(STABILITY_ELSE)
    for bound, label in reversed(STABILITY_BANDS):
        band = F.when(cv < bound, F.lit(label)).otherwise(band)
    enough = n >= MIN_POINTS
    found = g.select(
        entity_type,
        F.when(enough, band).otherwise(F.lit(INSUFFICIENT)).alias("stability"),
        F.when(enough, round_half_up(cv, 3)).alias("cv"),
        F.when(enough, round_half_up(m, 2)).alias("mean_monthly_sales"),
        F.when(enough, round_half_up(s, 2)).alias("std_monthly_sales"),
        F.when(enough, money("_min")).alias("min_monthly_sales"),
        F.when(enough, money("_max")).alias("max_monthly_sales"),
    )
    return _with_silent(found, df if entities is None else known(entities), entity_type, {"stability": INSUFFICIENT})


def run_rate_months(sales: DataFrame, *, as_of, entity: str | None = None, entity_type: str = "Brand", months: int = 12) -> DataFrame:
    """The monthly sales behind the stability of every entity, for those with enough months."""
    df = sales.filter(F.col(entity_type).isNotNull())
    if entity is not None:
        df = df.filter(F.col(entity_type) == F.lit(entity))
    series = monthly(df, as_of=as_of, months=months, keys=[entity_type])
    n = F.count(F.lit(1)).over(Window.partitionBy(entity_type))  # at most ``months`` rows
    return series.withColumn("_n", n).filter(F.col("_n") >= MIN_POINTS).select(entity_type, "Month", money("Sales").alias("Sales"))


def overstock_risk(sales: DataFrame, *, as_of, days_threshold: int = 90) -> DataFrame:
    """Accounts whose last-``days`` total exceeds 2 x (average line x days/30) and that have
    not bought in the last 30 days; Stock_Load_Index = recent / (average x days/30)."""
    c12 = dates.months_ago(as_of, 12)
    cd = dates.days_ago(as_of, days_threshold)
    c30 = dates.days_ago(as_of, 30)
    d = F.col("Invoice_Date")
    g = dates.since(sales, F.least(c12, cd)).groupBy("Customer_Name").agg(
        F.count(F.when(d >= c12, 1)).alias("_n12"),
        F.try_divide(F.sum(F.when(d >= c12, F.col("Amount"))).cast("double"),
                     F.count(F.when(d >= c12, F.col("Amount"))).cast("double")).alias("Avg_Monthly_Buy"),
        F.max(F.when(d >= c12, d)).alias("Last_Purchase"),
        F.count(F.when(d >= cd, 1)).alias("_nr"),
        F.sum(F.when(d >= cd, F.col("Amount"))).alias("_recent"),
    )
    factor = F.lit(days_threshold / 30.0)
    recent = money("_recent")
    avg = F.col("Avg_Monthly_Buy")
    return (
        g.filter((F.col("_n12") > 0) & (F.col("_nr") > 0) & F.col("Customer_Name").isNotNull())
        .filter((recent > avg * factor * F.lit(2.0)) & (F.col("Last_Purchase") < c30))
        .select("Customer_Name", "Avg_Monthly_Buy", recent.alias("Recent_Total"), "Last_Purchase",
                F.try_divide(recent, avg * factor).alias("Stock_Load_Index"))
        .orderBy(F.col("Stock_Load_Index").desc(), "Customer_Name")
    )
