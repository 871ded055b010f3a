"""Sales-versus-target achievement.

All four performance views are one pattern: ``sales_summary`` of one year LEFT JOIN
``target_summary`` on (Brand, Salesman, Month_and_Year, Customer_Name), then one grouped
aggregate. The join is literal by default: ``sales_summary`` has more keys than the join, so a
target row can be matched by several summary rows (the reference's fan-out, which is the
oracle). ``dedup_targets=True`` counts every 4-key target once (credited to one summary row).
Both sides are aggregates already; AQE picks broadcast or sort-merge from their real size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.expr import money, not_blank, optional_eq, safe_div, zero_if_null
from salescope.sources.schema import TARGET_JOIN_KEYS
from salescope.sources.tables import Tables


def _joined(t: Tables, year: int, *, dedup_targets: bool = False, filters: dict | None = None) -> DataFrame:
    ss = t.sales_summary.filter(F.col("Year") == F.lit(year))
    for col, val in (filters or {}).items():
        ss = optional_eq(ss, col, val)
    # Month labels are a join key and end with their year, so only that year's targets can match.
    ts = t.target_summary.filter(F.col("Year") == F.lit(year)).select(*TARGET_JOIN_KEYS, "Total_Target")
    if not dedup_targets:
        return ss.join(ts, TARGET_JOIN_KEYS, "left")
    # Each 4-key target once: summed per key, credited to one summary row of that key (the first
    # in key order), so views grouped by other columns still see every target exactly once.
    ts = ts.groupBy(*TARGET_JOIN_KEYS).agg(F.sum("Total_Target").alias("Total_Target"))
    rest = [c for c in ("Year", "Month_and_Year_Sort", "Manager", "GM", "Emirate", "Channel") if c in ss.columns]
    w = Window.partitionBy(*TARGET_JOIN_KEYS).orderBy(*rest)
    j = ss.withColumn("_rn", F.row_number().over(w)).join(ts, TARGET_JOIN_KEYS, "left")
    return j.withColumn("Total_Target", F.when(F.col("_rn") == 1, F.col("Total_Target"))).drop("_rn")


def _perf(g: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    target = F.coalesce(F.col("_target"), F.lit(0))
    return g.select(
        *keys,
        money("_sales").alias("Sales"),
        money(target).alias("Target"),
        *measures,
        achievement_expr(F.col("_sales"), target).alias("Achievement"),
        money(target - F.col("_sales")).alias("Gap"),
    )


def achievement_expr(sales: F.Column, target: F.Column) -> F.Column:
    """Sales / Target x 100 with a zero or missing target giving 0 (pandas inf/NaN -> 0)."""
    return zero_if_null(safe_div(sales, target) * F.lit(100.0))


def brand_performance(t: Tables, *, year: int, dedup_targets: bool = False, ordered: bool = True) -> DataFrame:
    """Per brand Sales, Target, Quantity, Transactions, #Customers, #Salesmen, Achievement, Gap."""
    g = _joined(t, year, dedup_targets=dedup_targets).groupBy("Brand").agg(
        F.sum("Total_Amount").alias("_sales"),
        F.sum("Total_Target").alias("_target"),
        F.sum("Total_Qty").alias("Quantity"),
        F.sum("Transaction_Count").alias("Transactions"),
        F.countDistinct("Customer_Name").alias("Customers"),
        F.countDistinct("Salesman").alias("Salesmen"),
    )
    out = _perf(g, ["Brand"], ["Quantity", "Transactions", "Customers", "Salesmen"])
    return out.orderBy(F.col("Sales").desc(), "Brand") if ordered else out


def gm_performance(t: Tables, *, year: int, dedup_targets: bool = False, ordered: bool = True) -> DataFrame:
    """Per non-empty GM."""
    g = (
        _joined(t, year, dedup_targets=dedup_targets)
        .filter(not_blank("GM"))
        .groupBy("GM")
        .agg(
            F.sum("Total_Amount").alias("_sales"),
            F.sum("Total_Target").alias("_target"),
            F.countDistinct("Brand").alias("Brands"),
            F.countDistinct("Salesman").alias("Salesmen"),
            F.countDistinct("Customer_Name").alias("Customers"),
            F.sum("Total_Qty").alias("Quantity"),
        )
    )
    out = _perf(g, ["GM"], ["Brands", "Salesmen", "Customers", "Quantity"])
    return out.orderBy(F.col("Sales").desc(), "GM") if ordered else out


def salesman_performance(t: Tables, *, year: int, gm_filter: str | None = None, brand_filter: str | None = None,
                         dedup_targets: bool = False, ordered: bool = True) -> DataFrame:
    """Per (Salesman, GM, Manager), with Avg_per_Customer; optional GM / Brand filter."""
    g = (
        _joined(t, year, dedup_targets=dedup_targets, filters={"GM": gm_filter, "Brand": brand_filter})
        .groupBy("Salesman", "GM", "Manager")
        .agg(
            F.sum("Total_Amount").alias("_sales"),
            F.sum("Total_Target").alias("_target"),
            F.countDistinct("Brand").alias("Brands"),
            F.countDistinct("Customer_Name").alias("Customers"),
            F.sum("Total_Qty").alias("Quantity"),
            F.sum("Transaction_Count").alias("Transactions"),
        )
    )
    out = _perf(g, ["Salesman", "GM", "Manager"], ["Brands", "Customers", "Quantity", "Transactions"])
    out = out.withColumn("Avg_per_Customer", zero_if_null(safe_div(F.col("Sales"), F.col("Customers"))))
    return out.orderBy(F.col("Sales").desc(), "Salesman", "GM", "Manager") if ordered else out


def account_performance(t: Tables, *, year: int, salesman_filter: str | None = None,
                        brand_filter: str | None = None, dedup_targets: bool = False,
                        ordered: bool = True) -> DataFrame:
    """T4: per (Customer, Salesman, Emirate, Channel)."""
    g = (
        _joined(t, year, dedup_targets=dedup_targets, filters={"Salesman": salesman_filter, "Brand": brand_filter})
        .groupBy("Customer_Name", "Salesman", "Emirate", "Channel")
        .agg(
            F.sum("Total_Amount").alias("_sales"),
            F.sum("Total_Target").alias("_target"),
            F.sum("Total_Qty").alias("Quantity"),
            F.sum("Total_Bonus").alias("Bonus_Qty"),
            F.sum("Transaction_Count").alias("Transactions"),
            F.countDistinct("Brand").alias("Brands_Bought"),
        )
    )
    out = _perf(g, ["Customer_Name", "Salesman", "Emirate", "Channel"],
                ["Quantity", "Bonus_Qty", "Transactions", "Brands_Bought"])
    return out.orderBy(F.col("Sales").desc(), "Customer_Name", "Salesman", "Emirate", "Channel") if ordered else out


def monthly_trend(t: Tables, *, year: int, dimension: str | None = None, dimension_value: str | None = None) -> DataFrame:
    """T5: per month Sales, Quantity from the summary; optional one-dimension filter."""
    ss = t.sales_summary.filter(F.col("Year") == F.lit(year))
    if dimension:
        ss = optional_eq(ss, dimension, dimension_value)
    return (
        ss.groupBy("Month_and_Year", "Month_and_Year_Sort")
        .agg(money(F.sum("Total_Amount")).alias("Sales"), F.sum("Total_Qty").alias("Quantity"))
        .orderBy("Month_and_Year_Sort", "Month_and_Year")
    )


def yoy_comparison(t: Tables, *, brand: str | None = None, salesman: str | None = None) -> DataFrame:
    """Per year Sales, Quantity, #Customers; optional brand / salesman."""
    ss = optional_eq(optional_eq(t.sales_summary, "Brand", brand), "Salesman", salesman)
    return (
        ss.groupBy("Year")
        .agg(money(F.sum("Total_Amount")).alias("Sales"), F.sum("Total_Qty").alias("Quantity"),
             F.countDistinct("Customer_Name").alias("Customers"))
        .orderBy("Year")
    )


# Recommendation texts and their achievement bands per entity type.
WORKING_DAYS = 22
REC_NO_DATA = "No data available for analysis"
REC_GAP = "🎯 **Gap Strategy**: Need AED {}/day run-rate to hit target."
REC_MOMENTUM = "🚀 **Momentum**: Exceeding target by AED {}! Upsell new lines."
REC_RULES = {
    "Brand": [
        (80, ["🔴 **Critical Action**: {name} is at {ach}%.",
              "1. **Availability**: Audit OOS in top 20 accounts.",
              "2. **Investment**: Divert trade spend to this brand immediately."]),
        (95, ["🟡 **Tactical Push**: {name} is close ({ach}%).",
              "🔹 Action: Run 'Buy 2 Get 1' for last week of month."]),
    ],
    "Salesman": [
        (70, ["🔴 **Coaching Required**: Achievement {ach}%.",
              "📋 **Audit**: Check top 5 non-buying accounts in route.",
              "🚶 **Activity**: Review Journey Plan compliance."]),
        (90, ["🟡 **Focus Area**: Gap closing mode ({ach}%).",
              "🔹 Action: Target accounts buying Brand A but not Brand B (Croos-sell)."]),
    ],
    "Account": [
        (50, ["🔴 **Risk Alert**: High risk of churn or credit issue.",
              "🤝 **Action**: Schedule Principal/Manager visit immediately."]),
        (80, ["🟡 **Development**: Account under-indexing.",
              "📦 **Mix**: Propose 2 new SKUs to boost basket size."]),
    ],
}


def _fill(template: str, name: F.Column, ach: F.Column) -> F.Column:
    parts: list[F.Column] = []
    rest = template
    while rest:
        i_n, i_a = rest.find("{name}"), rest.find("{ach}")
        hits = [(i, tag) for i, tag in ((i_n, "{name}"), (i_a, "{ach}")) if i >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        i, tag = min(hits)
        parts.append(F.lit(rest[:i]))
        parts.append(name if tag == "{name}" else ach)
        rest = rest[i + len(tag):]
    return F.concat(*parts)


def recommendations(perf: DataFrame, *, entity_type: str, key: str, entities: DataFrame | None = None) -> DataFrame:
    """Rule texts per entity from total gap (/22 working days) and mean achievement.

    One grouped aggregate per entity, then an array of texts chosen by ``when`` and exploded with
    its position: (key, Rank, Recommendation). ``entities`` lists those asked for: one without a row of the year gets
    the text for no data.
    """
    g = perf.groupBy(key).agg(F.sum(F.col("Gap").cast("decimal(38,2)")).cast("double").alias("_gap"), F.avg("Achievement").alias("_ach"), F.count(F.lit(1)).alias("_rows"))
    if entities is not None:
        g = entities.select(key).filter(F.col(key).isNotNull()).distinct().join(g, key, "left")
    gap, ach = F.col("_gap"), F.col("_ach")
    ach_txt = F.format_number(ach, 1)
    first = F.when(gap > 0, F.format_string(REC_GAP.replace("{}", "%s"), F.format_number(gap / WORKING_DAYS, 0))) \
        .otherwise(F.format_string(REC_MOMENTUM.replace("{}", "%s"), F.format_number(F.abs(gap), 0)))
    name = F.col(key).cast("string")
    tail = F.array().cast("array<string>")
    for bound, texts in reversed(REC_RULES.get(entity_type, [])):
        tail = F.when(ach < F.lit(bound), F.array(*[_fill(x, name, ach_txt) for x in texts])).otherwise(tail)
    recs = F.when(F.col("_rows") > 0, F.concat(F.array(first), tail)).otherwise(F.array(F.lit(REC_NO_DATA)))
    return g.select(key, F.posexplode(recs).alias("Rank", "Recommendation")).withColumn(
        "Rank", (F.col("Rank") + 1).cast("int"))


# Gap-analysis action bands.
GAP_ACTIONS = [(50, "Urgent review needed"), (80, "Increase focus")]
GAP_ACTION_ELSE = "Close the gap"


def gap_action(ach: F.Column) -> F.Column:
    expr = F.lit(GAP_ACTION_ELSE)
    for bound, text in reversed(GAP_ACTIONS):
        expr = F.when(ach < F.lit(bound), F.lit(text)).otherwise(expr)
    return expr


def gap_top(perf: DataFrame, *, key: str, n: int = 10) -> DataFrame:
    """Rows with Gap > 0, the ``n`` largest gaps, with the action band and a 20-char label."""
    return (
        perf.filter(F.col("Gap") > 0)
        .orderBy(F.col("Gap").desc(), F.col(key))
        .limit(n)
        .select(key, "Gap", "Achievement", gap_action(F.col("Achievement")).alias("Action"),
                F.concat(F.substring(F.col(key), 1, 20), F.lit("...")).alias("Label"))
    )
