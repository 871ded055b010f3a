"""DuckDB oracle text for growth/decline (G1-G7), the SQL surface (Q1-Q8) and documented questions."""

from salescope.plans.oracle_base import big, dbl, months_ago, rhu
from salescope.plans.params import BRAND, MASK, REPORT_YEAR, YEAR1, YEAR2

Y1, Y2 = YEAR1, YEAR2
S1 = f'SUM(CASE WHEN "Year" = {Y1} THEN Amount ELSE 0 END)'
S2 = f'SUM(CASE WHEN "Year" = {Y2} THEN Amount ELSE 0 END)'
Q1_ = f'SUM(CASE WHEN "Year" = {Y1} THEN Regular_Qty ELSE 0 END)'
Q2_ = f'SUM(CASE WHEN "Year" = {Y2} THEN Regular_Qty ELSE 0 END)'
SLICE = f'FROM sales WHERE "Year" IN ({Y1}, {Y2})'
PCT0 = "COALESCE(CAST(s2 - s1 AS DOUBLE) / NULLIF(CAST(s1 AS DOUBLE), 0) * 100.0, 0.0)"


def pivot(keys: str, extra: str = "", where: str = "") -> str:
    return f"SELECT {keys}, {S1} AS s1, {S2} AS s2 {extra} {SLICE} {where} GROUP BY {keys}"


ITEMS = f"""
SELECT Brand, Item_Desc, {dbl('s1')} AS Sales_y1, {dbl('s2')} AS Sales_y2, {big('q1')} AS Qty_y1, {big('q2')} AS Qty_y2,
       {dbl('s2 - s1')} AS Growth_Value, {PCT0} AS Growth_Pct
FROM ({pivot('Brand, Item_Desc', f', {Q1_} AS q1, {Q2_} AS q2')}) g
"""

CUSTOMERS = f"""
SELECT Brand, Customer_Name, Salesman, {dbl('s1')} AS Sales_y1, {dbl('s2')} AS Sales_y2,
       {dbl('s2 - s1')} AS Growth_Value, {PCT0} AS Growth_Pct
FROM ({pivot('Brand, Customer_Name, Salesman')}) g
"""

MONTH_PIVOT = f"""
SELECT Brand, substr(Month_and_Year, 1, 3) AS Month, {dbl(S1)} AS Sales_y1, {dbl(S2)} AS Sales_y2
{SLICE} GROUP BY Brand, substr(Month_and_Year, 1, 3)
"""

SUMMARY = f"""
SELECT Brand, {dbl('s1')} AS Total_y1, {dbl('s2')} AS Total_y2, {dbl('s2 - s1')} AS Growth_Value,
       CASE WHEN s1 > 0 THEN CAST(s2 - s1 AS DOUBLE) / CAST(s1 AS DOUBLE) * 100.0 ELSE 0.0 END AS Growth_Pct
FROM ({pivot('Brand')}) g
"""

CLASSES = f"""
SELECT * FROM (
  SELECT Brand, Item_Desc, Sales_y1, Sales_y2, Growth_Value, Growth_Pct,
         CASE WHEN Sales_y1 = 0 AND Sales_y2 > 0 THEN 'new' WHEN Sales_y1 > 0 AND Sales_y2 = 0 THEN 'discontinued'
              WHEN Growth_Value < 0 THEN 'declining' WHEN Growth_Value > 0 THEN 'growing' END AS Class
  FROM ({ITEMS}) i) WHERE Class IS NOT NULL
"""

TOP_CUSTOMERS = f"""
WITH c AS ({CUSTOMERS}),
up AS (SELECT *, row_number() OVER (PARTITION BY Brand ORDER BY Growth_Value DESC, Customer_Name, Salesman) AS rn
       FROM c WHERE Growth_Value > 0),
dn AS (SELECT *, row_number() OVER (PARTITION BY Brand ORDER BY Growth_Value ASC, Customer_Name, Salesman) AS rn
       FROM c WHERE Growth_Value < 0)
SELECT Brand, Customer_Name, Salesman, Sales_y1, Sales_y2, Growth_Value, Growth_Pct, 'growth' AS Direction
FROM up WHERE rn <= 5
UNION ALL
SELECT Brand, Customer_Name, Salesman, Sales_y1, Sales_y2, Growth_Value, Growth_Pct, 'decline' FROM dn WHERE rn <= 5
"""

OVERVIEW_ITEMS = f"""
SELECT Brand, "Year", {dbl('SUM(Amount)')} AS Total_Sales, COUNT(DISTINCT Customer_Name) AS Customers,
       COUNT(DISTINCT Item_Desc) AS Items
{SLICE} GROUP BY Brand, "Year"
"""

FLAGS = f"""
SELECT Brand, Item_Desc, Sales_y1, Sales_y2, Growth_Value, Growth_Pct, Growth_Value < 0 AS Is_Declining,
       Growth_Value > 0 AS Is_Growing, (Sales_y1 = 0 AND Sales_y2 > 0) AS Is_New,
       (Sales_y1 > 0 AND Sales_y2 = 0) AS Is_Discontinued
FROM ({ITEMS}) i
"""

CUSTOMERS_TOP50 = f"""
SELECT Brand, Customer_Name, Salesman, Sales_y1, Sales_y2, Growth_Value FROM (
  SELECT *, row_number() OVER (PARTITION BY Brand ORDER BY Sales_y1 DESC, Customer_Name, Salesman) AS rn
  FROM ({CUSTOMERS}) c) WHERE rn <= 50
"""

BRAND_MONTHS = f"""
SELECT Brand, Month_and_Year, "Year", {dbl('SUM(Amount)')} AS Sales {SLICE} GROUP BY Brand, Month_and_Year, "Year"
"""

CATEGORY_COUNTS = f"""
SELECT Brand, COUNT(*) FILTER (WHERE Is_Declining) AS Declining_Count, COUNT(*) FILTER (WHERE Is_Growing) AS Growing_Count,
       COUNT(*) FILTER (WHERE Is_New) AS New_Count, COUNT(*) FILTER (WHERE Is_Discontinued) AS Discontinued_Count
FROM ({FLAGS}) f GROUP BY Brand
"""

OVERVIEW = f"""
SELECT Brand, "Year", {dbl('SUM(Amount)')} AS Total_Sales, COUNT(*) AS Transactions,
       COUNT(DISTINCT Customer_Name) AS Customers, COUNT(DISTINCT Item_Desc) AS Items
{SLICE} GROUP BY Brand, "Year"
"""

OVERVIEW_SUMMARY = f"""
WITH o AS ({OVERVIEW}),
g AS (SELECT Brand, COALESCE(SUM(CASE WHEN "Year" = {Y1} THEN Total_Sales END), 0.0) AS t1,
             COALESCE(SUM(CASE WHEN "Year" = {Y2} THEN Total_Sales END), 0.0) AS t2, COUNT(*) AS n
      FROM o GROUP BY Brand)
SELECT Brand, t1 AS Total_y1, t2 AS Total_y2, CASE WHEN n >= 2 THEN t2 - t1 ELSE 0.0 END AS Growth_Value,
       CASE WHEN n >= 2 AND t1 > 0 THEN (t2 - t1) / t1 * 100.0 ELSE 0.0 END AS Growth_Pct
FROM g
"""

CHANGE_WORD = f"""
WITH s AS ({OVERVIEW_SUMMARY})
SELECT Brand, 'all' AS Focus, CASE WHEN Growth_Value > 0 THEN 'Growth' ELSE 'Decline' END AS Change_Word FROM s
UNION ALL SELECT Brand, 'growing', 'Growth' FROM s
UNION ALL SELECT Brand, 'declining', 'Decline' FROM s
"""


def contribution(d: str, limit, drop_empty: bool, order: str, *, per_brand: bool = True, where: str = "") -> str:
    col = f'"{d}"'
    keys = f"Brand, {col}" if per_brand else col
    having = "HAVING s1 > 0 OR s2 > 0" if drop_empty else ""
    inner = f"""SELECT {keys}, {S1} AS s1, {S2} AS s2 {SLICE} {where} GROUP BY {keys} {having}"""
    body = f"""SELECT {keys}, {dbl('s1')} AS Sales_y1, {dbl('s2')} AS Sales_y2, {dbl('s2 - s1')} AS Variance,
       {rhu("CAST(s2 - s1 AS DOUBLE) / NULLIF(CAST(s1 AS DOUBLE), 0) * 100.0", 2)} AS Growth_Pct FROM ({inner}) g"""
    if limit is None:
        return body
    if per_brand:
        return f"""SELECT {keys}, Sales_y1, Sales_y2, Variance, Growth_Pct FROM (
  SELECT *, row_number() OVER (PARTITION BY Brand ORDER BY Variance {order}, {col} ASC NULLS FIRST) AS rn
  FROM ({body}) b) WHERE rn <= {limit}"""
    return f"{body} ORDER BY Variance {order}, {col} ASC NULLS FIRST LIMIT {limit}"


SPECS = {"channel": ("Channel", None, False), "group": ("Group", 15, False), "item": ("Item_Desc", 15, True),
         "customer": ("Customer_Name", 10, True), "emirate": ("Emirate", None, False),
         "salesman": ("Salesman", 10, True)}

PIVOT_PCT = rhu("CAST(s2 - s1 AS DOUBLE) * 100.0 / NULLIF(CAST(s1 AS DOUBLE), 0)", 2)


def item_pivot(cond: str) -> str:
    return f"""
SELECT Item_Desc, {dbl('s1')} AS Sales_y1, {dbl('s2')} AS Sales_y2, {PIVOT_PCT} AS Growth_Pct
FROM ({pivot('Item_Desc', where=f"AND Brand = '{BRAND}'")}) g WHERE {cond}
"""


DECLINE_CONTRIBUTORS = "\nUNION ALL\n".join(
    f"""SELECT Brand, '{d}' AS Dimension, "{d}" AS Member, Sales_y1, Sales_y2, Variance, Growth_Pct
FROM ({contribution(d, lim, de, 'ASC')}) c{i} WHERE Variance < 0"""
    for i, (d, lim, de) in enumerate(SPECS[p] for p in ("group", "item", "customer", "emirate", "salesman", "channel")))

M12, M24 = months_ago(12), months_ago(24)

ORACLES = {
    "growth_items": ITEMS,
    "growth_customers": CUSTOMERS,
    "brand_month_pivot": MONTH_PIVOT,
    "growth_summary": SUMMARY,
    "growth_classes": CLASSES,
    "growth_top_customers": TOP_CUSTOMERS,
    "brand_overview_items": OVERVIEW_ITEMS,
    "growth_categories_overlapping": FLAGS,
    "growth_customers_top50": CUSTOMERS_TOP50,
    "brand_months": BRAND_MONTHS,
    "growth_category_counts": CATEGORY_COUNTS,
    "brand_overview": OVERVIEW,
    "brand_overview_summary": OVERVIEW_SUMMARY,
    "change_word": CHANGE_WORD,
    **{f"contrib_{p}": contribution(d, lim, de, "DESC") for p, (d, lim, de) in SPECS.items()},
    "contrib_brand_mask": contribution("Item_Desc", 15, True, "ASC", per_brand=False,
                                       where=f"AND Brand_Mask ILIKE '%{MASK}%'"),
    "non_growing_items": item_pivot("s2 < s1"),
    "growing_items": item_pivot("s2 > s1"),
    "top_customers": f"""SELECT Customer_Name, {dbl('SUM(Total_Amount)')} AS Sales FROM sales_summary
        WHERE "Year" = {REPORT_YEAR} GROUP BY Customer_Name ORDER BY Sales DESC, Customer_Name LIMIT 10""",
    "sales_vs_target_3key": f"""
SELECT s.Brand, {dbl('SUM(s.Total_Amount)')} AS Sales, {dbl('SUM(t.Total_Target)')} AS Target,
       {rhu(f"{dbl('SUM(s.Total_Amount)')} * 100.0 / NULLIF({dbl('SUM(t.Total_Target)')}, 0)", 1)} AS Achievement
FROM sales_summary s LEFT JOIN target_summary t
  ON s.Brand = t.Brand AND s.Salesman = t.Salesman AND s.Month_and_Year = t.Month_and_Year
WHERE s."Year" = {REPORT_YEAR} GROUP BY s.Brand""",
    "total_sales_by_year": f"""SELECT "Year", {dbl('SUM(Total_Amount)')} AS Sales FROM sales_summary GROUP BY "Year" """,
    "top10_brands": f"""SELECT Brand, {dbl('SUM(Total_Amount)')} AS Sales FROM sales_summary
        GROUP BY Brand ORDER BY Sales DESC, Brand LIMIT 10""",
    "top_bottom_n": f"""SELECT Salesman, {dbl('SUM(Total_Amount)')} AS Sales FROM sales_summary
        WHERE "Year" = {REPORT_YEAR} GROUP BY Salesman ORDER BY Sales ASC, Salesman ASC NULLS FIRST LIMIT 10""",
    "adhoc_sql": f"""SELECT Channel, COUNT(DISTINCT Customer_Name) AS Customers, {dbl('SUM(Amount)')} AS Sales
        FROM sales WHERE "Year" = {REPORT_YEAR} GROUP BY Channel""",
    "never_bought_brand": f"""SELECT DISTINCT Customer_Name FROM sales s WHERE Customer_Name IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM sales b WHERE b.Brand = '{BRAND}' AND b.Customer_Name = s.Customer_Name)""",
    "items_lost_coverage": f"""
SELECT Item_Code, Customers_Previous, Customers_Recent, Customers_Recent - Customers_Previous AS Change FROM (
  SELECT Item_Code,
         COUNT(DISTINCT CASE WHEN Invoice_Date >= {M24} AND Invoice_Date < {M12} THEN Customer_Name END)
           AS Customers_Previous,
         COUNT(DISTINCT CASE WHEN Invoice_Date >= {M12} THEN Customer_Name END) AS Customers_Recent
  FROM sales WHERE Invoice_Date >= {M24} GROUP BY Item_Code) g
WHERE Customers_Recent < Customers_Previous""",
    "underperforming_channels": f"SELECT * FROM ({contribution('Channel', None, False, 'ASC')}) c WHERE Variance < 0",
    "items_not_repeated": """
SELECT Item_Code, COUNT(*) FILTER (WHERE inv = 1) AS One_Time_Customers, COUNT(*) AS Customers FROM (
  SELECT Item_Code, Customer_Name, COUNT(DISTINCT Invoice_No) AS inv FROM sales GROUP BY Item_Code, Customer_Name) p
GROUP BY Item_Code HAVING COUNT(*) FILTER (WHERE inv = 1) > 0""",
    "customers_seasonal_buyers": """
SELECT Item_Code, Customer_Name, Months, Month_Count, Years FROM (
  SELECT Item_Code, Customer_Name,
         string_agg(DISTINCT lpad(CAST(month(Invoice_Date) AS VARCHAR), 2, '0'), ', '
                    ORDER BY lpad(CAST(month(Invoice_Date) AS VARCHAR), 2, '0')) AS Months,
         CAST(COUNT(DISTINCT month(Invoice_Date)) AS INTEGER) AS Month_Count, COUNT(DISTINCT "Year") AS Years
  FROM sales GROUP BY Item_Code, Customer_Name) p
WHERE Month_Count <= 3 AND Years >= 2""",
    "bonus_dependency": f"""
SELECT Brand,
       CAST(SUM(CASE WHEN "Year" = {Y1} THEN Bonus_Qty END) AS DOUBLE)
         / NULLIF(CAST(SUM(CASE WHEN "Year" = {Y1} THEN Regular_Qty END) AS DOUBLE), 0) AS Bonus_Ratio_y1,
       CAST(SUM(CASE WHEN "Year" = {Y2} THEN Bonus_Qty END) AS DOUBLE)
         / NULLIF(CAST(SUM(CASE WHEN "Year" = {Y2} THEN Regular_Qty END) AS DOUBLE), 0) AS Bonus_Ratio_y2,
       {dbl(f'{S2} - {S1}')} AS Sales_Growth
{SLICE} GROUP BY Brand""",
    "decline_contributors": DECLINE_CONTRIBUTORS,
}
