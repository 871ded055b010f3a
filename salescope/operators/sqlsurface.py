"""The SQL surface (Q1-Q8) and the documented questions that have no dedicated function.

Q-templates are Spark SQL text over the four registered views with values bound as named
parameters (never spliced). ``Tables.register`` must have been called on the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions import dates
from salescope.functions.expr import brand_filter, dim, money
from salescope.functions.series import round_half_up
from salescope.operators import growth
from salescope.sources.tables import Tables

def _pivot_sql(having: str, order: str) -> str:
    pct = ("(sign(x) * floor(abs(x) * 100.0 + 0.5) / 100.0)")
    raw = ("CAST(SUM(CASE WHEN Year = :y2 THEN Amount ELSE 0 END) - SUM(CASE WHEN Year = :y1 THEN Amount ELSE 0 END)"
           " AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(CASE WHEN Year = :y1 THEN Amount ELSE 0 END) AS DOUBLE), 0)")
    return f"""
SELECT Item_Desc,
       CAST(SUM(CASE WHEN Year = :y1 THEN Amount ELSE 0 END) AS DOUBLE) AS Sales_y1,
       CAST(SUM(CASE WHEN Year = :y2 THEN Amount ELSE 0 END) AS DOUBLE) AS Sales_y2,
       {pct.replace('x', f'({raw})')} AS Growth_Pct
FROM sales WHERE Brand = :brand AND Year IN (:y1, :y2)
GROUP BY Item_Desc
HAVING {having}
ORDER BY Growth_Pct {order}, Item_Desc
"""


NON_GROWING_SQL = _pivot_sql("SUM(CASE WHEN Year = :y2 THEN Amount ELSE 0 END) < "
                             "SUM(CASE WHEN Year = :y1 THEN Amount ELSE 0 END)", "ASC NULLS FIRST")
GROWING_SQL = _pivot_sql("SUM(CASE WHEN Year = :y2 THEN Amount ELSE 0 END) > "
                         "SUM(CASE WHEN Year = :y1 THEN Amount ELSE 0 END)", "DESC NULLS LAST")


def non_growing_items(spark: SparkSession, t: Tables, *, brand: str, year1: int, year2: int) -> DataFrame:
    """Q1: items whose second-year sales are below the first year's, worst growth first."""
    t.register(spark)
    return spark.sql(NON_GROWING_SQL, args={"brand": brand, "y1": year1, "y2": year2})


def growing_items(spark: SparkSession, t: Tables, *, brand: str, year1: int, year2: int) -> DataFrame:
    """Q2: items whose second-year sales exceed the first year's, best growth first."""
    t.register(spark)
    return spark.sql(GROWING_SQL, args={"brand": brand, "y1": year1, "y2": year2})


TOP_CUSTOMERS_SQL = """
SELECT Customer_Name, CAST(SUM(Total_Amount) AS DOUBLE) AS Sales
FROM sales_summary WHERE Year = :year
GROUP BY Customer_Name ORDER BY Sales DESC, Customer_Name LIMIT :n
"""


def top_customers(spark: SparkSession, t: Tables, *, year: int, n: int = 10) -> DataFrame:
    """Q3: top n customers by sales in a year (top-k report)."""
    t.register(spark)
    return spark.sql(TOP_CUSTOMERS_SQL, args={"year": year, "n": n})


def sales_vs_target_3key(t: Tables, *, year: int) -> DataFrame:
    """Q4: per brand Sales, Target, Achievement over the 3-key join (Brand, Salesman, Month).

    The literal join pairs every summary row with every target row of the same
    (Brand, Salesman, Month_and_Year), i.e. all pairs within a group. Its sums are computed
    without emitting the pairs: per 3-key group, sales are counted once per matching target row
    (once when none matches) and targets once per matching sales row.
    """
    keys = ["Brand", "Salesman", "Month_and_Year"]
    s = (t.sales_summary.filter(F.col("Year") == F.lit(year)).groupBy(*keys)
         .agg(F.sum("Total_Amount").alias("_a"), F.count(F.lit(1)).alias("_ns")))
    tt = t.target_summary.filter(F.col("Year") == F.lit(year)).groupBy(*keys).agg(F.sum("Total_Target").alias("_t"), F.count(F.lit(1)).alias("_nt"))
    j = s.join(tt, keys, "left")
    g = j.groupBy("Brand").agg(
        F.sum(F.col("_a") * F.coalesce(F.col("_nt"), F.lit(1))).alias("_sales"),
        F.sum(F.col("_t") * F.col("_ns")).alias("_target"),
    )
    return g.select(
        "Brand",
        money("_sales").alias("Sales"),
        money("_target").alias("Target"),
        round_half_up(F.try_divide(F.col("_sales").cast("double") * F.lit(100.0), F.col("_target").cast("double")), 1)
        .alias("Achievement"),
    ).orderBy(F.col("Sales").desc(), "Brand")


TOTAL_BY_YEAR_SQL = """
SELECT Year, CAST(SUM(Total_Amount) AS DOUBLE) AS Sales FROM sales_summary GROUP BY Year ORDER BY Year
"""

TOP10_BRANDS_SQL = """
SELECT Brand, CAST(SUM(Total_Amount) AS DOUBLE) AS Sales FROM sales_summary
GROUP BY Brand ORDER BY Sales DESC, Brand LIMIT 10
"""


def total_sales_by_year(spark: SparkSession, t: Tables) -> DataFrame:
    """Q5: total sales by year."""
    t.register(spark)
    return spark.sql(TOTAL_BY_YEAR_SQL)


def top10_brands(spark: SparkSession, t: Tables) -> DataFrame:
    """Q5: top 10 brands by sales."""
    t.register(spark)
    return spark.sql(TOP10_BRANDS_SQL)


def top_bottom_n(t: Tables, *, entity: str, year: int, n: int = 10, bottom: bool = False) -> DataFrame:
    """Q6: rank an entity by yearly sales, ascending (bottom) or descending (top), first n."""
    e = dim(entity)
    g = (t.sales_summary.filter(F.col("Year") == F.lit(year)).groupBy(e)
         .agg(money(F.sum("Total_Amount")).alias("Sales")))
    order = F.col("Sales").asc() if bottom else F.col("Sales").desc()
    return g.orderBy(order, F.col(e).asc_nulls_first()).limit(n)


def adhoc_sql(spark: SparkSession, t: Tables, sql: str, args: dict | None = None) -> DataFrame:
    """Q8: a user's SELECT over the four views (SRC5); raises the error text on failure."""
    from salescope.sources.catalog import execute_query

    df, err = execute_query(spark, t, sql, args, run=False)
    if err is not None:
        raise ValueError(err)
    return df


# ---- documented questions without a dedicated function ------------------------------------------

def never_bought_brand(sales: DataFrame, *, brand: str, member: str = "Customer_Name") -> DataFrame:
    """Customers (or account groups) that never bought a brand: anti join of all members."""
    m = dim(member)
    members = sales.select(m).filter(F.col(m).isNotNull()).distinct()
    buyers = sales.filter(brand_filter(brand)).select(m).distinct()
    return members.join(buyers, m, "left_anti")


def items_lost_coverage(sales: DataFrame, *, as_of, months: int = 12) -> DataFrame:
    """Items whose distinct-customer count fell: last ``months`` vs the equal period before."""
    c1 = dates.months_ago(as_of, months)
    c2 = dates.months_ago(as_of, 2 * months)
    d = F.col("Invoice_Date")
    per = (dates.since(sales, c2).filter(F.col("Customer_Name").isNotNull())
           .groupBy("Item_Code", "Customer_Name").agg(F.max(d).alias("_last"), F.min(d).alias("_first")))
    g = per.groupBy("Item_Code").agg(
        F.count(F.when(F.col("_first") < c1, 1)).alias("Customers_Previous"),
        F.count(F.when(F.col("_last") >= c1, 1)).alias("Customers_Recent"),
    )
    return (g.filter(F.col("Customers_Recent") < F.col("Customers_Previous"))
            .withColumn("Change", F.col("Customers_Recent") - F.col("Customers_Previous")))


def items_not_repeated(sales: DataFrame) -> DataFrame:
    """Items with customers who bought them on one invoice only: one-time buyers per item."""
    per = sales.groupBy("Item_Code", "Customer_Name").agg(F.countDistinct("Invoice_No").alias("_inv"))
    g = per.groupBy("Item_Code").agg(
        F.count(F.when(F.col("_inv") == 1, 1)).alias("One_Time_Customers"),
        F.count(F.lit(1)).alias("Customers"),
    )
    return g.filter(F.col("One_Time_Customers") > 0)


def customers_seasonal_buyers(sales: DataFrame, *, max_months: int = 3, min_years: int = 2) -> DataFrame:
    """(item, customer) pairs bought in at most ``max_months`` calendar months over >= ``min_years`` years.

    The month set per pair has at most 12 members, so collecting it is bounded.
    """
    per = sales.groupBy("Item_Code", "Customer_Name").agg(
        F.array_sort(F.collect_set(F.month("Invoice_Date"))).alias("_months"),
        F.countDistinct("Year").alias("Years"),
    )
    return per.filter((F.size("_months") <= max_months) & (F.col("Years") >= min_years)).select(
        "Item_Code", "Customer_Name",
        F.array_join(F.transform("_months", lambda m: F.lpad(m.cast("string"), 2, "0")), ", ").alias("Months"),
        F.size("_months").cast("int").alias("Month_Count"), "Years")


def bonus_dependency(sales: DataFrame, *, year1: int, year2: int) -> DataFrame:
    """Is growth bonus-driven: per brand bonus / regular quantity ratio in both years, and sales growth."""
    y1, y2 = F.col("Year") == year1, F.col("Year") == year2
    g = sales.filter(F.col("Year").isin(year1, year2)).groupBy("Brand").agg(
        F.sum(F.when(y1, F.col("Bonus_Qty"))).alias("_b1"), F.sum(F.when(y1, F.col("Regular_Qty"))).alias("_r1"),
        F.sum(F.when(y2, F.col("Bonus_Qty"))).alias("_b2"), F.sum(F.when(y2, F.col("Regular_Qty"))).alias("_r2"),
        F.coalesce(F.sum(F.when(y1, F.col("Amount"))), F.lit(0)).alias("_s1"),
        F.coalesce(F.sum(F.when(y2, F.col("Amount"))), F.lit(0)).alias("_s2"),
    )
    return g.select(
        "Brand",
        F.try_divide(F.col("_b1").cast("double"), F.col("_r1").cast("double")).alias("Bonus_Ratio_y1"),
        F.try_divide(F.col("_b2").cast("double"), F.col("_r2").cast("double")).alias("Bonus_Ratio_y2"),
        money(F.col("_s2") - F.col("_s1")).alias("Sales_Growth"),
    )


def decline_contributors(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Top contributors to a decline: the members that fell, in the brand report's dimension breakdowns."""
    return growth.contributions(sales, ("group", "item", "customer", "emirate", "salesman", "channel"), brand=brand, year1=year1, year2=year2,
                                only_falling=True)


def underperforming_channels(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Channels whose sales fell for a brand (channel contribution with negative variance)."""
    c = growth.contribution_by(sales, "channel", brand=brand, year1=year1, year2=year2, focus="declining")
    return c.filter(F.col("Variance") < 0)
