"""Growth / decline decomposition between two years.

Every operator takes ``brand``: a brand name filters to that brand (the reference's form);
``None`` runs the same report for every brand in one job, with ``Brand`` as an extra key and any
top-N applied per brand (``row_number`` over the brand, which Spark plans as a partial
window-group limit before the shuffle, so a dominant brand does not funnel all its rows into one
task). Year pivots are conditional sums over one pushed-down ``Year IN (y1, y2)`` scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.expr import brand_filter, dim, money, month_number, safe_div, sum_when, zero_if_null
from salescope.functions.series import round_half_up

FOCUS_VALUES = ("all", "growing", "declining")


def brand_slice(sales: DataFrame, brand: str | None, year1: int, year2: int, use_brand_mask: bool = False) -> DataFrame:
    df = sales.filter(F.col("Year").isin(year1, year2))
    if brand is not None:
        df = df.filter(brand_filter(brand, use_brand_mask))
    return df


def _keys(brand: str | None, *cols: str) -> list[str]:
    return (["Brand"] if brand is None else []) + list(cols)


def _y(year: int) -> Column:
    return F.col("Year") == F.lit(year)


def growth_pct_zero(y1: Column, y2: Column) -> Column:
    """(y2 - y1) / y1 x 100 with inf and NaN -> 0 (the pandas paths)."""
    return zero_if_null(safe_div(y2 - y1, y1) * F.lit(100.0))


def top_n(df: DataFrame, n: int | None, order: list[Column], partition: list[str]) -> DataFrame:
    """Top-n by ``order``; per partition keys when given (ties broken by the listed keys)."""
    if n is None:
        return df.orderBy(*partition, *order) if partition else df.orderBy(*order)
    if not partition:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def item_growth(sales: DataFrame, *, brand: str | None, year1: int, year2: int, ordered: bool = True) -> DataFrame:
    """G1: per item Sales/Qty of both years, Growth_Value, Growth_Pct (inf/NaN -> 0)."""
    keys = _keys(brand, "Item_Desc")
    g = brand_slice(sales, brand, year1, year2).groupBy(*keys).agg(
        sum_when(_y(year1), "Amount").alias("_s1"),
        sum_when(_y(year2), "Amount").alias("_s2"),
        sum_when(_y(year1), "Regular_Qty").alias("Qty_y1"),
        sum_when(_y(year2), "Regular_Qty").alias("Qty_y2"),
    )
    out = g.select(
        *keys,
        money("_s1").alias("Sales_y1"),
        money("_s2").alias("Sales_y2"),
        F.col("Qty_y1").cast("bigint").alias("Qty_y1"),
        F.col("Qty_y2").cast("bigint").alias("Qty_y2"),
        money(F.col("_s2") - F.col("_s1")).alias("Growth_Value"),
        growth_pct_zero(F.col("_s1"), F.col("_s2")).alias("Growth_Pct"),
    )
    return out.orderBy(*(["Brand"] if brand is None else []), F.col("Sales_y1").desc(), "Item_Desc") if ordered else out


def customer_growth(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Per (customer, salesman) Sales of both years, Growth_Value, Growth_Pct."""
    keys = _keys(brand, "Customer_Name", "Salesman")
    g = brand_slice(sales, brand, year1, year2).groupBy(*keys).agg(
        sum_when(_y(year1), "Amount").alias("_s1"),
        sum_when(_y(year2), "Amount").alias("_s2"),
    )
    return g.select(
        *keys,
        money("_s1").alias("Sales_y1"),
        money("_s2").alias("Sales_y2"),
        money(F.col("_s2") - F.col("_s1")).alias("Growth_Value"),
        growth_pct_zero(F.col("_s1"), F.col("_s2")).alias("Growth_Pct"),
    )


def month_pivot(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Per calendar month name ('Jan'..), Sales of both years, in calendar order."""
    mon = F.substring(F.col("Month_and_Year"), 1, 3)
    keys = _keys(brand)
    g = brand_slice(sales, brand, year1, year2).groupBy(*keys, mon.alias("Month")).agg(
        money(sum_when(_y(year1), "Amount")).alias("Sales_y1"),
        money(sum_when(_y(year2), "Amount")).alias("Sales_y2"),
    )
    return g.orderBy(*keys, month_number(F.col("Month")))


def growth_summary(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Totals of both years, growth value, growth % (0 when the first-year total <= 0)."""
    keys = _keys(brand)
    s = brand_slice(sales, brand, year1, year2)
    aggs = [sum_when(_y(year1), "Amount").alias("_t1"), sum_when(_y(year2), "Amount").alias("_t2")]
    g = s.groupBy(*keys).agg(*aggs) if keys else s.agg(*aggs)
    t1, t2 = F.col("_t1"), F.col("_t2")
    return g.select(
        *keys,
        money(t1).alias("Total_y1"),
        money(t2).alias("Total_y2"),
        money(t2 - t1).alias("Growth_Value"),
        F.when(t1 > 0, safe_div(t2 - t1, t1) * F.lit(100.0)).otherwise(F.lit(0.0)).alias("Growth_Pct"),
    )


# Exclusive growth classes, first hit wins.
CLASS_NEW, CLASS_DISCONTINUED, CLASS_DECLINING, CLASS_GROWING = "new", "discontinued", "declining", "growing"


def growth_classes(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Exclusive class per item (new / discontinued / declining / growing); unchanged dropped."""
    items = item_growth(sales, brand=brand, year1=year1, year2=year2, ordered=False)
    s1, s2, gv = F.col("Sales_y1"), F.col("Sales_y2"), F.col("Growth_Value")
    cls = (F.when((s1 == 0) & (s2 > 0), CLASS_NEW)
           .when((s1 > 0) & (s2 == 0), CLASS_DISCONTINUED)
           .when(gv < 0, CLASS_DECLINING)
           .when(gv > 0, CLASS_GROWING))
    out = items.select(*_keys(brand, "Item_Desc"), "Sales_y1", "Sales_y2", "Growth_Value", "Growth_Pct",
                       cls.alias("Class")).filter(F.col("Class").isNotNull())
    impact = F.when(F.col("Class") == CLASS_GROWING, -gv).otherwise(gv)
    return out.orderBy(*_keys(brand), "Class", impact, "Item_Desc")


def top_customers(sales: DataFrame, *, brand: str | None, year1: int, year2: int, n: int = 5) -> DataFrame:
    """The n largest growers and the n largest decliners by Growth_Value, tagged."""
    cust = customer_growth(sales, brand=brand, year1=year1, year2=year2)
    part = _keys(brand)
    ties = [F.col("Customer_Name"), F.col("Salesman")]
    up = top_n(cust.filter(F.col("Growth_Value") > 0), n, [F.col("Growth_Value").desc(), *ties], part)
    down = top_n(cust.filter(F.col("Growth_Value") < 0), n, [F.col("Growth_Value").asc(), *ties], part)
    return up.withColumn("Direction", F.lit("growth")).unionByName(down.withColumn("Direction", F.lit("decline")))


def year_overview(sales: DataFrame, *, brand: str | None, year1: int, year2: int,
                  use_brand_mask: bool = False, with_lines: bool = True, ordered: bool = True) -> DataFrame:
    """Per year Total_Sales, [line count,] distinct customers and item descriptions."""
    keys = _keys(brand, "Year")
    aggs = [money(F.sum("Amount")).alias("Total_Sales")]
    if with_lines:
        aggs.append(F.count(F.lit(1)).alias("Transactions"))
    aggs += [F.countDistinct("Customer_Name").alias("Customers"), F.countDistinct("Item_Desc").alias("Items")]
    out = brand_slice(sales, brand, year1, year2, use_brand_mask).groupBy(*keys).agg(*aggs)
    return out.orderBy(*keys) if ordered else out


def growth_flags(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """Overlapping sets as four flags per item (new is also growing, discontinued also declining)."""
    items = item_growth(sales, brand=brand, year1=year1, year2=year2, ordered=False)
    s1, s2, gv = F.col("Sales_y1"), F.col("Sales_y2"), F.col("Growth_Value")
    return items.select(
        *_keys(brand, "Item_Desc"), "Sales_y1", "Sales_y2", "Growth_Value", "Growth_Pct",
        (gv < 0).alias("Is_Declining"), (gv > 0).alias("Is_Growing"),
        ((s1 == 0) & (s2 > 0)).alias("Is_New"), ((s1 > 0) & (s2 == 0)).alias("Is_Discontinued"),
    )


def customers_top(sales: DataFrame, *, brand: str | None, year1: int, year2: int, n: int = 50) -> DataFrame:
    """The n (customer, salesman) pairs with the largest first-year sales, with growth value."""
    cust = customer_growth(sales, brand=brand, year1=year1, year2=year2).drop("Growth_Pct")
    return top_n(cust, n, [F.col("Sales_y1").desc(), F.col("Customer_Name"), F.col("Salesman")], _keys(brand))


def brand_months(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """G5d: per (Month_and_Year, Year) sales, in calendar order."""
    keys = _keys(brand, "Month_and_Year", "Year")
    g = brand_slice(sales, brand, year1, year2).groupBy(*keys).agg(money(F.sum("Amount")).alias("Sales"))
    return g.orderBy(*_keys(brand), "Year", month_number(F.substring(F.col("Month_and_Year"), 1, 3)))


def category_counts(sales: DataFrame, *, brand: str | None, year1: int, year2: int) -> DataFrame:
    """G5e: counts of the four overlapping sets, one row (per brand)."""
    flags = growth_flags(sales, brand=brand, year1=year1, year2=year2)
    keys = _keys(brand)
    aggs = [F.count(F.when(F.col(c), 1)).alias(n) for c, n in (
        ("Is_Declining", "Declining_Count"), ("Is_Growing", "Growing_Count"),
        ("Is_New", "New_Count"), ("Is_Discontinued", "Discontinued_Count"))]
    return flags.groupBy(*keys).agg(*aggs) if keys else flags.agg(*aggs)


def overview_summary(sales: DataFrame, *, brand: str | None, year1: int, year2: int,
                     use_brand_mask: bool = False) -> DataFrame:
    """Totals and growth; when only one of the two years has sales, growth is 0."""
    ov = year_overview(sales, brand=brand, year1=year1, year2=year2, use_brand_mask=use_brand_mask, ordered=False)
    keys = _keys(brand)
    aggs = [
        F.sum(F.when(_y(year1), F.col("Total_Sales"))).alias("_t1"),
        F.sum(F.when(_y(year2), F.col("Total_Sales"))).alias("_t2"),
        F.count(F.lit(1)).alias("_years"),
    ]
    g = ov.groupBy(*keys).agg(*aggs) if keys else ov.agg(*aggs).filter(F.col("_years") > 0)
    t1, t2 = F.coalesce(F.col("_t1"), F.lit(0.0)), F.coalesce(F.col("_t2"), F.lit(0.0))
    both = F.col("_years") >= 2
    return g.select(
        *keys,
        t1.alias("Total_y1"),
        t2.alias("Total_y2"),
        F.when(both, t2 - t1).otherwise(F.lit(0.0)).alias("Growth_Value"),
        F.when(both & (t1 > 0), (t2 - t1) / t1 * F.lit(100.0)).otherwise(F.lit(0.0)).alias("Growth_Pct"),
    )


def contribution(sales: DataFrame, dimension: str, *, brand: str | None, year1: int, year2: int,
                 focus: str = "all", limit: int | None = None, drop_empty: bool = False,
                 use_brand_mask: bool = False) -> DataFrame:
    """G6c-G6i: per member of ``dimension``: Sales of both years, Variance, Growth_Pct.

    Growth_Pct is NULL when the first year is 0 (SQL path) and rounded to 2 places; ordered by
    Variance ascending for 'declining'/'all' and descending for 'growing'; optional HAVING
    (either year > 0) and LIMIT (per brand when ``brand`` is None).
    """
    if focus not in FOCUS_VALUES:
        raise ValueError(f"focus must be one of {FOCUS_VALUES}")
    d = dim(dimension)
    keys = _keys(brand, d)
    g = brand_slice(sales, brand, year1, year2, use_brand_mask).groupBy(*keys).agg(
        sum_when(_y(year1), "Amount").alias("_s1"),
        sum_when(_y(year2), "Amount").alias("_s2"),
    )
    if drop_empty:
        g = g.filter((F.col("_s1") > 0) | (F.col("_s2") > 0))
    out = g.select(
        *keys,
        money("_s1").alias("Sales_y1"),
        money("_s2").alias("Sales_y2"),
        money(F.col("_s2") - F.col("_s1")).alias("Variance"),
        round_half_up(safe_div(F.col("_s2") - F.col("_s1"), F.col("_s1")) * F.lit(100.0), 2).alias("Growth_Pct"),
    )
    order = F.col("Variance").desc() if focus == "growing" else F.col("Variance").asc()
    return top_n(out, limit, [order, F.col(d).asc_nulls_first()], _keys(brand))


# Per-dimension limit and HAVING of the brand report (dimension, limit, drop_empty).
CONTRIBUTION_SPECS = {
    "channel": ("Channel", None, False),
    "group": ("Group", 15, False),
    "item": ("Item_Desc", 15, True),
    "customer": ("Customer_Name", 10, True),
    "emirate": ("Emirate", None, False),
    "salesman": ("Salesman", 10, True),
}


def contribution_by(sales: DataFrame, part: str, **kw) -> DataFrame:
    d, limit, drop_empty = CONTRIBUTION_SPECS[part]
    return contribution(sales, d, limit=limit, drop_empty=drop_empty, **kw)


def contributions(sales: DataFrame, parts: tuple[str, ...], *, brand: str | None, year1: int, year2: int, only_falling: bool = False,
                  focus: str = "all", use_brand_mask: bool = False) -> DataFrame:
    """The breakdowns of several dimensions in one scan: (Brand,) Dimension, Member, Sales of both years, Variance and
    Growth_Pct, each dimension with its own limit, smallest Variance first (largest with the focus on growth).

    Each row counts once under each dimension; sums are taken before the shuffle.
    """
    specs = [CONTRIBUTION_SPECS[p] for p in parts]
    members = F.explode(F.array(*[F.struct(F.lit(d).alias("Dimension"), F.col(d).alias("Member")) for d, _, _ in specs]))
    keys = _keys(brand, "Dimension", "Member")
    g = (brand_slice(sales, brand, year1, year2, use_brand_mask).select(*_keys(brand), "Year", "Amount", members.alias("_m"))
         .select(*_keys(brand), "Year", "Amount", "_m.*").groupBy(*keys).agg(
             sum_when(_y(year1), "Amount").alias("_s1"), sum_when(_y(year2), "Amount").alias("_s2")))
    wanted, most = F.lit(True), F.lit(None).cast("int")
    for d, limit, drop_empty in specs:
        if drop_empty:
            wanted = wanted & ((F.col("Dimension") != d) | (F.col("_s1") > 0) | (F.col("_s2") > 0))
        if limit is not None:
            most = F.when(F.col("Dimension") == d, limit).otherwise(most)
    change = F.col("_s2") - F.col("_s1")
    w = Window.partitionBy(*_keys(brand, "Dimension")).orderBy(
        change.desc() if focus == "growing" else change.asc(), F.col("Member").asc_nulls_first())
    falling = g.filter(wanted & (change < 0) if only_falling else wanted)
    ranked = falling.withColumn("_rn", F.row_number().over(w)).filter(most.isNull() | (F.col("_rn") <= most))
    return ranked.select(*keys, money("_s1").alias("Sales_y1"), money("_s2").alias("Sales_y2"), money(change).alias("Variance"),
                         round_half_up(safe_div(change, F.col("_s1")) * F.lit(100.0), 2).alias("Growth_Pct"))


def brand_report(sales: DataFrame, *, brand: str | None, year1: int, year2: int, focus: str = "all",
                 use_brand_mask: bool = False) -> dict[str, DataFrame]:
    """The eight parts of the two-year report of a brand (of every brand without one): the years' totals, their
    summary, and the breakdowns by channel, group, item, customer, emirate and salesman. The breakdowns share one
    scan of the two years."""
    if focus not in FOCUS_VALUES:
        raise ValueError(f"focus must be one of {FOCUS_VALUES}")
    kw = dict(brand=brand, year1=year1, year2=year2, use_brand_mask=use_brand_mask)
    members = contributions(sales, tuple(CONTRIBUTION_SPECS), focus=focus, **kw)
    parts = {"overview": year_overview(sales, **kw), "summary": overview_summary(sales, **kw)}
    for name, (d, _, _) in CONTRIBUTION_SPECS.items():
        parts[name] = members.filter(F.col("Dimension") == d).drop("Dimension").withColumnRenamed("Member", d)
    return parts


def change_word(growth_value: Column, focus: str) -> Column:
    """G7: 'Growth' / 'Decline' / 'Change' heading from the focus and the sign of the growth."""
    if focus == "growing":
        return F.lit("Growth")
    if focus == "declining":
        return F.lit("Decline")
    if focus == "all":
        return F.when(growth_value > 0, F.lit("Growth")).otherwise(F.lit("Decline"))
    return F.lit("Change")


def change_words(summary: DataFrame) -> DataFrame:
    """G7 for every focus value over an overview summary: (keys..., Focus, Change_Word)."""
    keys = [c for c in summary.columns if c in ("Brand",)]
    parts = [summary.select(*keys, F.lit(f).alias("Focus"), change_word(F.col("Growth_Value"), f).alias("Change_Word"))
             for f in FOCUS_VALUES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
