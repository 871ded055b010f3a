"""DuckDB oracle text for the report-page operators (D1-D30), over the T1-T4 oracle views."""

from salescope.plans.oracle_base import rhu
from salescope.plans.oracle_targets import account_perf, brand_perf, gm_perf, salesman_perf

BP, GP, SP, AP = brand_perf(), gm_perf(), salesman_perf(), account_perf()


def dsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(38,2))) AS DOUBLE)"


def labels(values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS Category" for v in values)


def counted(src: str, cat_expr: str, values: list[str], extra: str = "") -> str:
    return f"""
SELECT L.Category, CAST(COALESCE(g.Count, 0) AS BIGINT) AS Count {', ' + extra if extra else ''}
FROM ({labels(values)}) L LEFT JOIN (
  SELECT Category, COUNT(*) AS Count, SUM(CAST(Sales AS DECIMAL(38,2))) AS s FROM (
    SELECT *, {cat_expr} AS Category FROM ({src}) x) y
  WHERE Category IS NOT NULL GROUP BY Category) g ON L.Category = g.Category"""


BRAND_KPIS = f"""
SELECT COUNT(*) AS Total_Brands, {dsum('Sales')} AS Total_Sales, {dsum('Target')} AS Total_Target,
       CASE WHEN SUM(CAST(Target AS DECIMAL(38,2))) > 0 THEN {dsum('Sales')} / {dsum('Target')} * 100.0 ELSE 0.0 END
         AS Overall_Achievement
FROM ({BP}) b"""

TOP10 = f"SELECT * FROM ({BP}) b ORDER BY Sales DESC, Brand LIMIT 10"
BRAND_TOP10_SHARE = f"""
SELECT Brand, Sales, Target, Achievement, Sales / NULLIF(tot, 0) * 100.0 AS Share_Pct
FROM ({TOP10}) t CROSS JOIN (SELECT {dsum('Sales')} AS tot FROM ({TOP10}) u) s"""


def hist(src: str) -> str:
    return f"""
WITH b AS ({src}), s AS (SELECT MIN(Achievement) AS lo, MAX(Achievement) AS hi FROM b),
j AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((Achievement - lo) / (hi - lo) * 20.0) + 1, 20) END
                  AS INTEGER) AS Bin, lo, hi FROM b, s)
SELECT Bin, lo + (Bin - 1) * (hi - lo) / 20.0 AS Lower, COUNT(*) AS Count FROM j GROUP BY Bin, lo, hi"""


GM_KPIS = f"""
SELECT COUNT(*) AS Total_GMs, {dsum('Sales')} AS Total_Sales, {rhu('AVG(Achievement)', 6)} AS Avg_Achievement,
       CAST(SUM(Salesmen) AS BIGINT) AS Total_Salesmen FROM ({GP}) g"""

GM_GAUGE = f"""
SELECT GM, Sales, Achievement,
       CASE WHEN Achievement < 70 THEN '0-70' WHEN Achievement < 100 THEN '70-100' ELSE '100-150' END AS Band
FROM ({GP}) g ORDER BY Sales DESC, GM LIMIT 1"""

SALESMAN_KPIS = f"""
SELECT COUNT(*) AS Total_Salesmen, {dsum('Sales')} AS Total_Sales, {rhu('AVG(Achievement)', 6)} AS Avg_Achievement,
       COUNT(*) FILTER (WHERE Achievement >= 100) AS Above_Target, CAST(SUM(Customers) AS BIGINT) AS Total_Customers,
       CAST(COUNT(*) FILTER (WHERE Achievement >= 100) AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE) AS Above_Target_Pct
FROM ({SP}) s"""

CAT = "CASE WHEN Achievement < 70 THEN 'Needs Support' WHEN Achievement < 100 THEN 'Potential' ELSE 'Stars' END"
SALESMAN_CATEGORIES = f"""
WITH c AS (SELECT *, {CAT} AS Category FROM ({SP}) s),
f AS (SELECT Category, string_agg(Salesman, ', ' ORDER BY rk) AS First_Salesmen FROM (
        SELECT Category, Salesman, row_number() OVER (PARTITION BY Category ORDER BY Sales DESC, Salesman) AS rk FROM c) r
      WHERE rk <= 5 GROUP BY Category)
SELECT q.Category, q.Count, COALESCE(f.First_Salesmen, '') AS First_Salesmen
FROM ({counted(SP, CAT, ['Stars', 'Potential', 'Needs Support'])}) q LEFT JOIN f ON q.Category = f.Category"""

ACCOUNT_KPIS = f"""
SELECT COUNT(*) AS Total_Accounts, {dsum('Sales')} AS Total_Sales, {rhu('AVG(Achievement)', 6)} AS Avg_Achievement,
       COUNT(*) FILTER (WHERE Transactions >= 3) AS Active_Accounts,
       CAST(SUM(Transactions) AS BIGINT) AS Total_Transactions
FROM ({AP}) a"""

SIZE = ("CASE WHEN Sales <= 0 THEN NULL WHEN Sales <= 10000 THEN 'Micro (<10K)' WHEN Sales <= 50000 THEN "
        "'Small (10-50K)' WHEN Sales <= 200000 THEN 'Medium (50-200K)' WHEN Sales <= 1000000 THEN 'Large (200K-1M)' "
        "ELSE 'Enterprise (>1M)' END")
SIZE_LABELS = ['Micro (<10K)', 'Small (10-50K)', 'Medium (50-200K)', 'Large (200K-1M)', 'Enterprise (>1M)']
HEALTH = "CASE WHEN Achievement < 50 THEN 'Critical' WHEN Achievement < 100 THEN 'At Risk' ELSE 'Healthy' END"

ACC_KEYS = "Customer_Name, Salesman, Emirate, Channel"

EXEC = f"""
SELECT {dsum('Sales')} AS Total_Sales, {dsum('Target')} AS Total_Target,
       CAST(SUM(CAST(Target AS DECIMAL(38,2))) - SUM(CAST(Sales AS DECIMAL(38,2))) AS DOUBLE) AS Total_Gap,
       CASE WHEN SUM(CAST(Target AS DECIMAL(38,2))) > 0 THEN {dsum('Sales')} / {dsum('Target')} * 100.0 ELSE 0.0 END
         AS Overall_Achievement,
       CASE WHEN SUM(CAST(Target AS DECIMAL(38,2))) > 0 THEN {dsum('Sales')} / {dsum('Target')} * 100.0 ELSE 0.0 END
         - 100.0 AS Achievement_Delta
FROM ({BP}) b"""


def ranked(src: str, key: str, n: int, cols: str) -> str:
    return f"""
SELECT {key}, {cols}, CAST(row_number() OVER (ORDER BY Gap DESC, {key}) AS INTEGER) AS Rank FROM (
  SELECT * FROM ({src}) x WHERE Gap > 0 ORDER BY Gap DESC, {key} LIMIT {n}) y"""


QUAD = f"""
WITH g AS (SELECT * FROM ({SP}) s WHERE Gap > 0),
m AS (SELECT median(Gap) AS mg, median(CAST(Customers AS DOUBLE)) AS mc FROM g),
j AS (SELECT g.*, CASE WHEN Gap > mg AND Customers < mc THEN 'High Gap, Few Customers'
                       WHEN Gap > mg THEN 'High Gap, Many Customers'
                       WHEN Customers < mc THEN 'Low Gap, Few Customers' ELSE 'Low Gap, Many Customers' END AS Q
      FROM g, m)
SELECT category, count FROM (
  SELECT L.Category AS category, CAST(COALESCE(c.n, 0) AS BIGINT) AS count FROM (
    {labels(['High Gap, Few Customers', 'High Gap, Many Customers', 'Low Gap, Few Customers',
             'Low Gap, Many Customers'])}) L
  LEFT JOIN (SELECT Q, COUNT(*) AS n FROM j GROUP BY Q) c ON L.Category = c.Q) z"""

ORACLES = {
    "brand_kpis": BRAND_KPIS,
    "brand_top10_share": BRAND_TOP10_SHARE,
    "achievement_hist": hist(BP),
    "achievement_hist_salesman": hist(SP),
    "gm_kpis": GM_KPIS,
    "gm_gauge": GM_GAUGE,
    "salesman_kpis": SALESMAN_KPIS,
    "salesman_top15": f"SELECT Salesman, GM, Sales, Target, Achievement FROM ({SP}) s ORDER BY Sales DESC, Salesman LIMIT 15",
    "salesman_avg_top10": f"""SELECT Salesman, Avg_per_Customer, Customers FROM ({SP}) s
        ORDER BY Avg_per_Customer DESC, Salesman LIMIT 10""",
    "salesman_categories": SALESMAN_CATEGORIES,
    "account_kpis": ACCOUNT_KPIS,
    "account_top15": f"SELECT {ACC_KEYS}, Sales FROM ({AP}) a ORDER BY Sales DESC, {ACC_KEYS} LIMIT 15",
    "emirate_distribution": f"SELECT Emirate, {dsum('Sales')} AS Sales, COUNT(Customer_Name) AS Accounts FROM ({AP}) a GROUP BY Emirate",
    "channel_sales": f"SELECT Channel, {dsum('Sales')} AS Sales FROM ({AP}) a GROUP BY Channel",
    "account_size_distribution": counted(AP, SIZE, SIZE_LABELS),
    "account_health": counted(AP, HEALTH, ["Healthy", "At Risk", "Critical"],
                              "CAST(COALESCE(g.s, 0) AS DOUBLE) AS Sales"),
    "account_underperforming": f"""SELECT {ACC_KEYS}, Sales, Target, Gap, Achievement FROM ({AP}) a WHERE Gap > 0
        ORDER BY Gap DESC, {ACC_KEYS} LIMIT 10""",
    "executive_summary": EXEC,
    "brand_gaps": ranked(BP, "Brand", 20, "Gap, Achievement, Customers"),
    "gm_gaps": f"""SELECT GM, Gap, Salesmen, Achievement,
        CASE WHEN Achievement < 70 THEN 'red' WHEN Achievement < 100 THEN 'yellow' ELSE 'green' END AS Status,
        CASE WHEN Achievement < 70 THEN 'Urgent intervention' ELSE 'Focus improvement' END AS Action
        FROM ({GP}) g WHERE Gap > 0""",
    "salesman_gap_quadrants": QUAD,
    "account_gaps": ranked(AP, "Customer_Name", 20, "Salesman, Emirate, Channel, Gap, Achievement"),
    "emirate_gaps": f"""SELECT Emirate, {dsum('Gap')} AS Total_Gap, COUNT(Customer_Name) AS Accounts
        FROM ({AP}) a WHERE Gap > 0 GROUP BY Emirate""",
    "priority_accounts": f"""SELECT {ACC_KEYS}, Sales, Target, Gap, Achievement FROM ({AP}) a WHERE Gap > 0
        ORDER BY Gap DESC, {ACC_KEYS} LIMIT 5""",
    "salesmen_needing_support": f"""SELECT Salesman, Achievement FROM ({SP}) s WHERE Achievement < 70
        ORDER BY Achievement ASC, Salesman LIMIT 5""",
    "quick_win_brands": f"""SELECT Brand, Gap, Achievement FROM ({BP}) b WHERE Achievement >= 80 AND Achievement < 100
        ORDER BY Gap DESC, Brand LIMIT 5""",
    "high_value_accounts_below_target": f"""
SELECT Customer_Name, Salesman, Target, Achievement FROM ({AP}) a
WHERE Target > (SELECT quantile_cont(Target, 0.75) FROM ({AP}) q) AND Achievement < 100
ORDER BY Target DESC, {ACC_KEYS} LIMIT 5""",
    "critical_counts": f"""SELECT (SELECT COUNT(*) FROM ({BP}) b WHERE Achievement < 50) AS Critical_Brands,
        (SELECT COUNT(*) FROM ({SP}) s WHERE Achievement < 50) AS Critical_Salesmen""",
    "improvement_zone": f"""SELECT COUNT(*) AS Improvement_Zone_Brands FROM ({BP}) b
        WHERE Achievement >= 70 AND Achievement < 100""",
    "best_practice_salesmen": f"""SELECT Salesman, Achievement, Customers, Sales FROM ({SP}) s WHERE Achievement >= 100
        ORDER BY Sales DESC, Salesman LIMIT 5""",
    "gm_scatter": f"SELECT GM, Salesmen, Achievement, Sales, Customers, Brands FROM ({GP}) g",
    "salesman_scatter": f"""SELECT Salesman, Customers, Gap, Sales, Achievement FROM ({SP}) s WHERE Gap > 0
        ORDER BY Gap DESC, Salesman LIMIT 50""",
}
