"""DuckDB oracle text for the achievement operators (T1-T8), the marts and the load audit."""

from salescope.plans.oracle_base import big, dbl
from salescope.plans.params import BRAND, REPORT_YEAR

Y = REPORT_YEAR


def joined(where: str = "") -> str:
    return f"""
  SELECT s.*, t.Total_Target FROM sales_summary s
  LEFT JOIN target_summary t ON s.Brand = t.Brand AND s.Salesman = t.Salesman
    AND s.Month_and_Year = t.Month_and_Year AND s.Customer_Name = t.Customer_Name
  WHERE s."Year" = {Y} {where}"""


SALES = "SUM(Total_Amount)"
TARGET = "COALESCE(SUM(Total_Target), 0)"
ACH = f"COALESCE({dbl(SALES)} / NULLIF({dbl(TARGET)}, 0) * 100.0, 0.0)"
PERF = f"{dbl(SALES)} AS Sales, {dbl(TARGET)} AS Target, {ACH} AS Achievement, {dbl(f'{TARGET} - {SALES}')} AS Gap"


def brand_perf() -> str:
    return f"""
SELECT Brand, {PERF}, {big('SUM(Total_Qty)')} AS Quantity, {big('SUM(Transaction_Count)')} AS Transactions,
       COUNT(DISTINCT Customer_Name) AS Customers, COUNT(DISTINCT Salesman) AS Salesmen
FROM ({joined()}) j GROUP BY Brand"""


def gm_perf() -> str:
    return f"""
SELECT GM, {PERF}, COUNT(DISTINCT Brand) AS Brands, COUNT(DISTINCT Salesman) AS Salesmen,
       COUNT(DISTINCT Customer_Name) AS Customers, {big('SUM(Total_Qty)')} AS Quantity
FROM ({joined("AND s.GM IS NOT NULL AND s.GM != ''")}) j GROUP BY GM"""


def salesman_perf(where: str = "") -> str:
    return f"""
SELECT Salesman, GM, Manager, {PERF}, COUNT(DISTINCT Brand) AS Brands, COUNT(DISTINCT Customer_Name) AS Customers,
       {big('SUM(Total_Qty)')} AS Quantity, {big('SUM(Transaction_Count)')} AS Transactions,
       COALESCE({dbl(SALES)} / NULLIF(CAST(COUNT(DISTINCT Customer_Name) AS DOUBLE), 0), 0.0) AS Avg_per_Customer
FROM ({joined(where)}) j GROUP BY Salesman, GM, Manager"""


def account_perf(where: str = "") -> str:
    return f"""
SELECT Customer_Name, Salesman, Emirate, Channel, {PERF}, {big('SUM(Total_Qty)')} AS Quantity,
       {big('SUM(Total_Bonus)')} AS Bonus_Qty, {big('SUM(Transaction_Count)')} AS Transactions,
       COUNT(DISTINCT Brand) AS Brands_Bought
FROM ({joined(where)}) j GROUP BY Customer_Name, Salesman, Emirate, Channel"""


MONTHLY_TREND = f"""
SELECT Month_and_Year, Month_and_Year_Sort, {dbl('SUM(Total_Amount)')} AS Sales, {big('SUM(Total_Qty)')} AS Quantity
FROM sales_summary WHERE "Year" = {Y} GROUP BY Month_and_Year, Month_and_Year_Sort ORDER BY Month_and_Year_Sort
"""

MONTHLY_TREND_BRAND = f"""
SELECT Month_and_Year, Month_and_Year_Sort, {dbl('SUM(Total_Amount)')} AS Sales, {big('SUM(Total_Qty)')} AS Quantity
FROM sales_summary WHERE "Year" = {Y} AND Brand = '{BRAND}'
GROUP BY Month_and_Year, Month_and_Year_Sort ORDER BY Month_and_Year_Sort
"""

YOY = f"""
SELECT "Year", {dbl('SUM(Total_Amount)')} AS Sales, {big('SUM(Total_Qty)')} AS Quantity,
       COUNT(DISTINCT Customer_Name) AS Customers
FROM sales_summary GROUP BY "Year" ORDER BY "Year"
"""

YOY_BRAND = f"""
SELECT "Year", {dbl('SUM(Total_Amount)')} AS Sales, {big('SUM(Total_Qty)')} AS Quantity,
       COUNT(DISTINCT Customer_Name) AS Customers
FROM sales_summary WHERE Brand = '{BRAND}' GROUP BY "Year" ORDER BY "Year"
"""

RECOMMENDATIONS = f"""
WITH b AS ({brand_perf()}),
g AS (SELECT Brand, SUM(Gap) AS gap, AVG(Achievement) AS ach FROM b GROUP BY Brand),
t AS (
  SELECT Brand, 1 AS Rank,
         CASE WHEN gap > 0 THEN '🎯 **Gap Strategy**: Need AED ' || format('{{:,.0f}}', gap / 22) || '/day run-rate to hit target.'
              ELSE '🚀 **Momentum**: Exceeding target by AED ' || format('{{:,.0f}}', abs(gap)) || '! Upsell new lines.' END
           AS Recommendation FROM g
  UNION ALL SELECT Brand, 2, '🔴 **Critical Action**: ' || Brand || ' is at ' || format('{{:,.1f}}', ach) || '%.' FROM g WHERE ach < 80
  UNION ALL SELECT Brand, 3, '1. **Availability**: Audit OOS in top 20 accounts.' FROM g WHERE ach < 80
  UNION ALL SELECT Brand, 4, '2. **Investment**: Divert trade spend to this brand immediately.' FROM g WHERE ach < 80
  UNION ALL SELECT Brand, 2, '🟡 **Tactical Push**: ' || Brand || ' is close (' || format('{{:,.1f}}', ach) || '%).'
            FROM g WHERE ach >= 80 AND ach < 95
  UNION ALL SELECT Brand, 3, '🔹 Action: Run ''Buy 2 Get 1'' for last week of month.' FROM g WHERE ach >= 80 AND ach < 95
)
SELECT Brand, CAST(Rank AS INTEGER) AS Rank, Recommendation FROM t
"""

def advice(view: str, key: str, bands: list[tuple[str, list[str]]], listed: str) -> str:
    """Everyone of ``listed`` with the text of the gap, then the texts of the first band that fits; without rows one text."""
    cases = " ".join(f"WHEN {cond} THEN [{', '.join(texts)}]" for cond, texts in bands)
    return f"""
WITH figures AS (SELECT {key}, CAST(sum(CAST(Gap AS DECIMAL(38,2))) AS DOUBLE) AS gap, avg(Achievement) AS ach FROM ({view}) v GROUP BY {key}),
texts AS (
  SELECT {key}, CASE WHEN gap IS NULL THEN ['No data available for analysis'] ELSE list_concat(
    [if(gap > 0, '🎯 **Gap Strategy**: Need AED ' || format('{{:,.0f}}', gap / 22) || '/day run-rate to hit target.',
        '🚀 **Momentum**: Exceeding target by AED ' || format('{{:,.0f}}', abs(gap)) || '! Upsell new lines.')],
    CASE {cases} ELSE [] END) END AS said
  FROM ({listed}) LEFT JOIN figures USING ({key})
)
SELECT {key}, CAST(unnest(range(1, len(said) + 1)) AS INTEGER) AS Rank, unnest(said) AS Recommendation FROM texts
"""


# The texts for salesmen and accounts.
RECOMMENDATIONS_SALESMAN = advice(salesman_perf(), "Salesman", [
    ("ach < 70", ["'🔴 **Coaching Required**: Achievement ' || format('{:,.1f}', ach) || '%.'",
                  "'📋 **Audit**: Check top 5 non-buying accounts in route.'", "'🚶 **Activity**: Review Journey Plan compliance.'"]),
    ("ach < 90", ["'🟡 **Focus Area**: Gap closing mode (' || format('{:,.1f}', ach) || '%).'",
                  "'🔹 Action: Target accounts buying Brand A but not Brand B (Croos-sell).'"]),
], f"SELECT DISTINCT Salesman FROM ({salesman_perf()}) s")
RECOMMENDATIONS_ACCOUNT = advice(account_perf(), "Customer_Name", [
    ("ach < 50", ["'🔴 **Risk Alert**: High risk of churn or credit issue.'", "'🤝 **Action**: Schedule Principal/Manager visit immediately.'"]),
    ("ach < 80", ["'🟡 **Development**: Account under-indexing.'", "'📦 **Mix**: Propose 2 new SKUs to boost basket size.'"]),
], "SELECT DISTINCT Customer_Name FROM sales")

GAP_TOP10 = f"""
SELECT Brand, Gap, Achievement,
       CASE WHEN Achievement < 50 THEN 'Urgent review needed' WHEN Achievement < 80 THEN 'Increase focus'
            ELSE 'Close the gap' END AS Action,
       substr(Brand, 1, 20) || '...' AS Label
FROM ({brand_perf()}) b WHERE Gap > 0 ORDER BY Gap DESC, Brand LIMIT 10
"""

SALES_SUMMARY = f"""
SELECT "Year", Month_and_Year, Month_and_Year_Sort, Brand, Salesman, Manager, GM, Emirate, Channel, Customer_Name,
       {dbl('Total_Amount')} AS Total_Amount, {big('Total_Qty')} AS Total_Qty, {big('Total_Bonus')} AS Total_Bonus,
       Transaction_Count
FROM sales_summary
"""

TARGET_SUMMARY = f"""
SELECT Month_and_Year, Month_and_Year_Sort, Brand, Salesman, Manager, GM, Emirate, Channel, Customer_Name,
       {dbl('Total_Target')} AS Total_Target
FROM target_summary
"""

LOAD_AUDIT_YEARS = """
SELECT "Year", COUNT(*) AS Row_Count FROM sales GROUP BY "Year"
"""

LOAD_AUDIT_TOP_BRANDS = """
SELECT Brand, COUNT(*) AS Row_Count FROM sales GROUP BY Brand ORDER BY Row_Count DESC, Brand LIMIT 5
"""

LOAD_AUDIT_TOTALS = """
SELECT (SELECT COUNT(*) FROM sales) AS Sales_Rows, (SELECT COUNT(DISTINCT Brand) FROM sales) AS Distinct_Brands,
       (SELECT COUNT(*) FROM target) AS Target_Rows, (SELECT COUNT(*) FROM sales_summary) AS Sales_Summary_Rows,
       (SELECT COUNT(*) FROM target_summary) AS Target_Summary_Rows
"""

SELECTOR_GM = f"""SELECT DISTINCT GM FROM sales_summary WHERE "Year" = {Y} AND GM IS NOT NULL AND GM != '' ORDER BY GM"""
SELECTOR_BRAND = f"""SELECT DISTINCT Brand FROM sales_summary WHERE "Year" = {Y} ORDER BY Brand"""
SELECTOR_SALESMAN = f"""SELECT DISTINCT Salesman FROM sales_summary WHERE "Year" = {Y} ORDER BY Salesman"""

ORACLES = {
    "brand_performance": brand_perf(),
    "gm_performance": gm_perf(),
    "salesman_performance": salesman_perf(),
    "salesman_performance_brand": salesman_perf(f"AND s.Brand = '{BRAND}'"),
    "account_performance": account_perf(),
    "account_performance_brand": account_perf(f"AND s.Brand = '{BRAND}'"),
    "monthly_trend": MONTHLY_TREND,
    "monthly_trend_brand": MONTHLY_TREND_BRAND,
    "yoy_comparison": YOY,
    "yoy_comparison_brand": YOY_BRAND,
    "recommendations": RECOMMENDATIONS,
    "recommendations_salesman": RECOMMENDATIONS_SALESMAN,
    "recommendations_account": RECOMMENDATIONS_ACCOUNT,
    "gap_top10": GAP_TOP10,
    "sales_summary": SALES_SUMMARY,
    "target_summary": TARGET_SUMMARY,
    "load_audit_years": LOAD_AUDIT_YEARS,
    "load_audit_top_brands": LOAD_AUDIT_TOP_BRANDS,
    "load_audit_totals": LOAD_AUDIT_TOTALS,
    "selector_gm": SELECTOR_GM,
    "selector_brand": SELECTOR_BRAND,
    "selector_salesman": SELECTOR_SALESMAN,
}
