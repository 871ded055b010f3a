"""Report-page operators (D1-D30): the data behind the dashboard cards and charts.

Inputs are the performance views (T1-T4). Every output is a small DataFrame: a global
aggregate, a banded count, or a top-k with the entity as the last sort key (deterministic ties).
Money totals are summed as DECIMAL(38,2) (a 2-decimal double converts back exactly), so totals do
not depend on summation order; means of ratios are rounded to 6 places for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.quantile import exact_quantile, exact_quantiles
from salescope.functions.rank import global_rank
from salescope.functions.series import round_half_up

CENTS = "decimal(38,2)"


def dsum(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(CENTS)).cast("double")


def mean6(c: str) -> Column:
    return round_half_up(F.avg(F.col(c)), 6)


def top(df: DataFrame, n: int, key: str, by: str, ascending: bool = False) -> DataFrame:
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(order, F.col(key).asc_nulls_first()).limit(n)


def bands(value: Column, rules: list[tuple[float, str]], otherwise: str) -> Column:
    """First rule with ``value < bound`` wins."""
    expr = F.lit(otherwise)
    for bound, label in reversed(rules):
        expr = F.when(value < F.lit(bound), F.lit(label)).otherwise(expr)
    return expr


def label_counts(df: DataFrame, label: Column, labels: list[str], measures: list[Column] | None = None) -> DataFrame:
    """Counts (and measures) per label, every listed label present (zero counts kept)."""
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "Category string")
    rest = [c for c in df.columns if c != "Category"]
    g = df.select(label.alias("Category"), *rest).filter(F.col("Category").isNotNull()).groupBy("Category").agg(
        F.count(F.lit(1)).alias("Count"), *(measures or []))
    out = names.join(g, "Category", "left").withColumn("Count", F.coalesce(F.col("Count"), F.lit(0)).cast("bigint"))
    return out


# ---- brand page ---------------------------------------------------------------------------------

def brand_kpis(brand_perf: DataFrame) -> DataFrame:
    """#brands, total sales, total target, weighted achievement (total sales / total target)."""
    g = brand_perf.agg(F.count(F.lit(1)).alias("Total_Brands"), F.sum(F.col("Sales").cast(CENTS)).alias("_s"),
                       F.sum(F.col("Target").cast(CENTS)).alias("_t"))
    return g.select("Total_Brands", F.col("_s").cast("double").alias("Total_Sales"),
                    F.col("_t").cast("double").alias("Total_Target"),
                    F.when(F.col("_t") > 0, F.col("_s").cast("double") / F.col("_t").cast("double") * F.lit(100.0))
                    .otherwise(F.lit(0.0)).alias("Overall_Achievement"))


def brand_top10_share(brand_perf: DataFrame) -> DataFrame:
    """Top 10 brands by sales with target, achievement and share of the top-10 sales."""
    t10 = top(brand_perf, 10, "Brand", "Sales")
    total = t10.agg(F.sum(F.col("Sales").cast(CENTS)).cast("double").alias("_tot"))
    return t10.crossJoin(F.broadcast(total)).select(  # 10 rows x 1 row
        "Brand", "Sales", "Target", "Achievement",
        (F.try_divide(F.col("Sales"), F.col("_tot")) * F.lit(100.0)).alias("Share_Pct"))


def achievement_hist(perf: DataFrame, bins: int = 20) -> DataFrame:
    """D3: equal-width histogram of Achievement over [min, max] (the max falls in the last bin)."""
    stats = perf.agg(F.min("Achievement").alias("_lo"), F.max("Achievement").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((F.col("Achievement") - lo) / (hi - lo) * F.lit(float(bins))) + F.lit(1), F.lit(bins)))
    j = perf.select("Achievement").crossJoin(F.broadcast(stats))  # n rows x 1 row
    g = j.groupBy(b.cast("int").alias("Bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("Count"))
    return g.select("Bin", (lo + (F.col("Bin") - F.lit(1)) * (hi - lo) / F.lit(float(bins))).alias("Lower"), "Count")


# ---- GM page ------------------------------------------------------------------------------------

def gm_kpis(gm_perf: DataFrame) -> DataFrame:
    """#GMs, total sales, mean achievement, total salesmen."""
    return gm_perf.agg(F.count(F.lit(1)).alias("Total_GMs"), dsum("Sales").alias("Total_Sales"),
                       mean6("Achievement").alias("Avg_Achievement"),
                       F.sum("Salesmen").cast("bigint").alias("Total_Salesmen"))


# Bands of the gauge.
GAUGE_BANDS = [(70, "0-70"), (100, "70-100")]


def gm_gauge(gm_perf: DataFrame) -> DataFrame:
    """The top GM by sales and the gauge band of its achievement."""
    return top(gm_perf, 1, "GM", "Sales").select(
        "GM", "Sales", "Achievement", bands(F.col("Achievement"), GAUGE_BANDS, "100-150").alias("Band"))


# ---- salesman page ------------------------------------------------------------------------------

def salesman_kpis(sp: DataFrame) -> DataFrame:
    """Count, total sales, mean achievement, # and % at or above 100, total customers."""
    g = sp.agg(F.count(F.lit(1)).alias("Total_Salesmen"), dsum("Sales").alias("Total_Sales"),
               mean6("Achievement").alias("Avg_Achievement"),
               F.count(F.when(F.col("Achievement") >= 100, 1)).alias("Above_Target"),
               F.sum("Customers").cast("bigint").alias("Total_Customers"))
    return g.withColumn("Above_Target_Pct", F.try_divide(F.col("Above_Target") * F.lit(100.0),
                                                         F.col("Total_Salesmen").cast("double")))


def salesman_top15(sp: DataFrame) -> DataFrame:
    """Top 15 salesmen by sales."""
    return top(sp, 15, "Salesman", "Sales").select("Salesman", "GM", "Sales", "Target", "Achievement")


def salesman_avg_top10(sp: DataFrame) -> DataFrame:
    """Top 10 salesmen by average sales per customer."""
    return top(sp, 10, "Salesman", "Avg_per_Customer").select("Salesman", "Avg_per_Customer", "Customers")


# Salesman categories.
CATEGORY_RULES = [(70, "Needs Support"), (100, "Potential")]
CATEGORY_LABELS = ["Stars", "Potential", "Needs Support"]


def salesman_categories(sp: DataFrame, first: int = 5) -> DataFrame:
    """Stars >= 100, Potential 70-<100, Needs Support < 70: count and the first 5 by sales."""
    cat = bands(F.col("Achievement"), CATEGORY_RULES, "Stars")
    c = sp.withColumn("Category", cat)
    w = Window.partitionBy("Category").orderBy(F.col("Sales").desc(), F.col("Salesman"))
    firsts = (c.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= first)
              .groupBy("Category").agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("_rk", "Salesman"))), lambda s: s["Salesman"]), ", ")
                  .alias("First_Salesmen")))
    counts = label_counts(c, F.col("Category"), CATEGORY_LABELS)
    return counts.select("Category", "Count").join(firsts, "Category", "left").withColumn(
        "First_Salesmen", F.coalesce(F.col("First_Salesmen"), F.lit("")))


# ---- account page -------------------------------------------------------------------------------

def account_kpis(ap: DataFrame) -> DataFrame:
    """Accounts, total sales, mean achievement, active (>= 3 transactions), total transactions."""
    return ap.agg(F.count(F.lit(1)).alias("Total_Accounts"), dsum("Sales").alias("Total_Sales"),
                  mean6("Achievement").alias("Avg_Achievement"),
                  F.count(F.when(F.col("Transactions") >= 3, 1)).alias("Active_Accounts"),
                  F.sum("Transactions").cast("bigint").alias("Total_Transactions"))


def account_top15(ap: DataFrame) -> DataFrame:
    """Top 15 accounts by sales."""
    return ap.orderBy(F.col("Sales").desc(), "Customer_Name", "Salesman", "Emirate", "Channel").limit(15).select(
        "Customer_Name", "Salesman", "Emirate", "Channel", "Sales")


def emirate_distribution(ap: DataFrame) -> DataFrame:
    """Sales and number of account rows per emirate."""
    return ap.groupBy("Emirate").agg(dsum("Sales").alias("Sales"), F.count("Customer_Name").alias("Accounts"))


def channel_sales(ap: DataFrame) -> DataFrame:
    """Sales per channel."""
    return ap.groupBy("Channel").agg(dsum("Sales").alias("Sales"))


# Account size classes, right-closed bins (0,10K] (10K,50K] (50K,200K] (200K,1M] (1M,inf).
SIZE_BINS = [(10000, "Micro (<10K)"), (50000, "Small (10-50K)"), (200000, "Medium (50-200K)"),
             (1000000, "Large (200K-1M)")]
SIZE_TOP = "Enterprise (>1M)"


def account_size_distribution(ap: DataFrame) -> DataFrame:
    """Accounts per size class (sales <= 0 are not classified; empty classes count 0)."""
    s = F.col("Sales")
    cat = F.when(s <= 0, F.lit(None).cast("string"))
    for bound, label in SIZE_BINS:
        cat = cat.when(s <= F.lit(float(bound)), F.lit(label))
    cat = cat.otherwise(F.lit(SIZE_TOP))
    return label_counts(ap, cat, [b[1] for b in SIZE_BINS] + [SIZE_TOP])


# Account health classes.
HEALTH_RULES = [(50, "Critical"), (100, "At Risk")]


def account_health(ap: DataFrame) -> DataFrame:
    """Healthy >= 100 / At Risk 50-<100 / Critical < 50: count and sales."""
    cat = bands(F.col("Achievement"), HEALTH_RULES, "Healthy")
    out = label_counts(ap, cat, ["Healthy", "At Risk", "Critical"], [F.sum(F.col("Sales").cast(CENTS)).alias("_s")])
    return out.select("Category", "Count", F.coalesce(F.col("_s"), F.lit(0)).cast("double").alias("Sales"))


def account_underperforming(ap: DataFrame, n: int = 10) -> DataFrame:
    """Accounts with a gap, the ``n`` largest gaps."""
    return (ap.filter(F.col("Gap") > 0)
            .orderBy(F.col("Gap").desc(), "Customer_Name", "Salesman", "Emirate", "Channel").limit(n)
            .select("Customer_Name", "Salesman", "Emirate", "Channel", "Sales", "Target", "Gap", "Achievement"))


# ---- gap page -----------------------------------------------------------------------------------

def executive_summary(brand_perf: DataFrame) -> DataFrame:
    """Total sales and target, gap, achievement and its delta to 100."""
    g = brand_perf.agg(F.sum(F.col("Sales").cast(CENTS)).alias("_s"), F.sum(F.col("Target").cast(CENTS)).alias("_t"))
    ach = F.when(F.col("_t") > 0, F.col("_s").cast("double") / F.col("_t").cast("double") * F.lit(100.0)) \
        .otherwise(F.lit(0.0))
    return g.select(F.col("_s").cast("double").alias("Total_Sales"), F.col("_t").cast("double").alias("Total_Target"),
                    (F.col("_t") - F.col("_s")).cast("double").alias("Total_Gap"), ach.alias("Overall_Achievement"),
                    (ach - F.lit(100.0)).alias("Achievement_Delta"))


def ranked_gaps(perf: DataFrame, key: str, n: int | None, cols: list[str]) -> DataFrame:
    """Rows with Gap > 0 by gap descending (first n), with their rank."""
    order = [F.col("Gap").desc(), F.col(key)]
    g = perf.filter(F.col("Gap") > 0)
    if n is None:
        return global_rank(g.select(key, *cols), order).withColumn("Rank", F.col("Rank").cast("int"))
    g = g.orderBy(*order).limit(n)
    w = Window.orderBy(*order)  # over at most n rows
    return g.select(key, *cols).withColumn("Rank", F.row_number().over(w))


# Status colours.
GM_STATUS = [(70, "red"), (100, "yellow")]


def gm_gaps(gm_perf: DataFrame) -> DataFrame:
    """GMs with a gap; status band <70 / <100 / else and the action text."""
    a = F.col("Achievement")
    return gm_perf.filter(F.col("Gap") > 0).select(
        "GM", "Gap", "Salesmen", "Achievement", bands(a, GM_STATUS, "green").alias("Status"),
        F.when(a < 70, F.lit("Urgent intervention")).otherwise(F.lit("Focus improvement")).alias("Action"))


# Quadrants of gap and customers.
QUADRANTS = ["High Gap, Few Customers", "High Gap, Many Customers", "Low Gap, Few Customers",
             "Low Gap, Many Customers"]


def salesman_gap_quadrants(sp: DataFrame) -> DataFrame:
    """Salesmen with a gap in 4 quadrants against the medians of Gap and Customers of those rows."""
    g = sp.filter(F.col("Gap") > 0)
    med = exact_quantiles(g, {"_mg": ("Gap", 0.5), "_mc": ("Customers", 0.5)})
    j = g.crossJoin(F.broadcast(med))  # n rows x 1 row
    high = F.col("Gap") > F.col("_mg")
    few = F.col("Customers") < F.col("_mc")
    q = (F.when(high & few, QUADRANTS[0]).when(high, QUADRANTS[1]).when(few, QUADRANTS[2]).otherwise(QUADRANTS[3]))
    out = label_counts(j, q, QUADRANTS)
    return out.select(F.col("Category").alias("category"), F.col("Count").alias("count"))


def emirate_gaps(ap: DataFrame) -> DataFrame:
    """Total gap and number of accounts per emirate over accounts with a gap."""
    return ap.filter(F.col("Gap") > 0).groupBy("Emirate").agg(
        dsum("Gap").alias("Total_Gap"), F.count("Customer_Name").alias("Accounts"))


def salesmen_needing_support(sp: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest achievements below 70."""
    return top(sp.filter(F.col("Achievement") < 70), n, "Salesman", "Achievement", ascending=True).select(
        "Salesman", "Achievement")


def quick_win_brands(bp: DataFrame, n: int = 5) -> DataFrame:
    """Brands at 80-<100 achievement, the n largest gaps."""
    return top(bp.filter((F.col("Achievement") >= 80) & (F.col("Achievement") < 100)), n, "Brand", "Gap").select(
        "Brand", "Gap", "Achievement")


def high_value_accounts_below_target(ap: DataFrame, n: int = 5) -> DataFrame:
    """Accounts with Target above the 75th percentile (linear) and achievement < 100, top n by target."""
    q = exact_quantile(ap, "Target", 0.75, alias="_q")
    j = ap.crossJoin(F.broadcast(q))  # n rows x 1 row
    f = j.filter((F.col("Target") > F.col("_q")) & (F.col("Achievement") < 100))
    return f.orderBy(F.col("Target").desc(), "Customer_Name", "Salesman", "Emirate", "Channel").limit(n).select(
        "Customer_Name", "Salesman", "Target", "Achievement")


def critical_counts(bp: DataFrame, sp: DataFrame) -> DataFrame:
    """Number of brands and of salesmen below 50 % achievement."""
    b = bp.agg(F.count(F.when(F.col("Achievement") < 50, 1)).alias("Critical_Brands"))
    s = sp.agg(F.count(F.when(F.col("Achievement") < 50, 1)).alias("Critical_Salesmen"))
    return b.crossJoin(s)  # 1 row x 1 row


def improvement_zone(bp: DataFrame) -> DataFrame:
    """Number of brands at 70-<100 achievement."""
    return bp.agg(F.count(F.when((F.col("Achievement") >= 70) & (F.col("Achievement") < 100), 1))
                  .alias("Improvement_Zone_Brands"))


def best_practice_salesmen(sp: DataFrame, n: int = 5) -> DataFrame:
    """Salesmen at or above target, the n largest by sales."""
    return top(sp.filter(F.col("Achievement") >= 100), n, "Salesman", "Sales").select(
        "Salesman", "Achievement", "Customers", "Sales")


def gm_scatter(gm_perf: DataFrame) -> DataFrame:
    """(team size, achievement, sales) per GM."""
    return gm_perf.select("GM", "Salesmen", "Achievement", "Sales", "Customers", "Brands")


def salesman_scatter(sp: DataFrame, n: int = 50) -> DataFrame:
    """The n largest salesman gaps as (customers, gap, sales, achievement) points."""
    return top(sp.filter(F.col("Gap") > 0), n, "Salesman", "Gap").select(
        "Salesman", "Customers", "Gap", "Sales", "Achievement")
