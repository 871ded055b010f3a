"""DuckDB oracle text for the supply-chain dashboard counts."""

from salescope.plans.oracle_base import dbl, days_ago, months_ago, rhu
from salescope.plans.oracle_coverage import COVERAGE_LOSS, brand_windows
from salescope.plans.oracle_patterns import item_pattern
from salescope.plans.oracle_stock import CHANNEL_OOS, MULTI_ACCOUNT_OOS, OOS_ITEMS
from salescope.plans.params import BRAND

D30, M12, M24 = days_ago(30), months_ago(12), months_ago(24)


def parts(brand_pred: str) -> dict[str, str]:
    b = f"AND {brand_pred}" if brand_pred else ""
    return {
        "oos_items": f"""
WITH early AS (SELECT Item_Code, Item_Desc, Brand, CAST(sum(Amount) AS DOUBLE) / count(Amount) AS mean_line FROM sales
               WHERE Invoice_Date >= {M12} AND Invoice_Date < {D30} {b} GROUP BY ALL HAVING sum(Amount) > 10000),
late AS (SELECT Item_Code, Item_Desc, Brand, {dbl('sum(Amount)')} AS total FROM sales WHERE Invoice_Date >= {D30} {b} GROUP BY ALL)
SELECT early.Brand FROM early LEFT JOIN late USING (Item_Code, Brand) WHERE coalesce(total, 0.0) < mean_line * 0.3""",
        "supply_issues": f"""
SELECT Brand FROM (SELECT Item_Code, Item_Desc, Brand, Customer_Name, max(Invoice_Date) AS latest FROM sales
                   WHERE Invoice_Date >= {M12} {b} GROUP BY ALL)
WHERE latest < {D30} GROUP BY Item_Code, Item_Desc, Brand HAVING count(Customer_Name) >= 5""",
        "coverage_loss": f"""
SELECT Brand FROM sales WHERE Customer_Name IS NOT NULL {b} GROUP BY Brand, Customer_Name
HAVING max(Invoice_Date) < {M12} AND max(Invoice_Date) >= {M24}""",
        "seasonal_items": f"""
WITH cand AS (SELECT Item_Code, Item_Desc, Brand FROM sales WHERE Invoice_Date >= {M24} {b}
              GROUP BY Item_Code, Item_Desc, Brand HAVING SUM(Amount) > 50000),
pat AS ({item_pattern(M24)})
SELECT c.Brand FROM cand c JOIN pat p ON c.Item_Code = p.Item_Code WHERE p.is_seasonal""",
        "anomalies": f"""
WITH r AS (SELECT Brand, Item_Code, strftime(Invoice_Date, '%Y-%m') AS Month, Item_Desc, SUM(Amount) AS Sales
           FROM sales WHERE Invoice_Date >= {M12} {b}
           GROUP BY Brand, Item_Code, Item_Desc, strftime(Invoice_Date, '%Y-%m')),
st AS (SELECT Brand, Item_Code, COUNT(*) AS n, CAST(SUM(Sales) AS DOUBLE) / COUNT(*) AS mean,
              sqrt(CAST(CAST(COUNT(*) AS DECIMAL(20,0)) * SUM(Sales * Sales) - SUM(Sales) * SUM(Sales) AS DOUBLE)
                   / CAST(COUNT(*) * COUNT(*) AS DOUBLE)) AS std
       FROM r GROUP BY Brand, Item_Code)
SELECT r.Brand FROM r JOIN st ON r.Brand = st.Brand AND r.Item_Code = st.Item_Code
WHERE st.n >= 3 AND abs(CAST(r.Sales AS DOUBLE) - st.mean) / NULLIF(st.std, 0) > 2.5""",
    }


def dashboard(brand_pred: str, names: tuple[str, ...]) -> str:
    p = parts(brand_pred)
    b = f"AND {brand_pred}" if brand_pred else ""
    ctes = ",\n".join(f"c_{n} AS (SELECT Brand, COUNT(*) AS k FROM ({p[n]}) x GROUP BY Brand)" for n in names)
    joins = " ".join(f"LEFT JOIN c_{n} ON c_{n}.Brand = B.Brand" for n in names)
    cols = ", ".join(f"CAST(COALESCE(c_{n}.k, 0) AS BIGINT) AS {n}_count" for n in names)
    return f"""
WITH B AS (SELECT DISTINCT Brand FROM sales WHERE Brand IS NOT NULL {b}),
{ctes}
SELECT B.Brand AS brand, {cols} FROM B {joins}
"""


ALL = ("oos_items", "supply_issues", "coverage_loss", "seasonal_items", "anomalies")
CARDS = ("oos_items", "supply_issues", "coverage_loss", "seasonal_items")

ITEM_HEALTH = f"""
WITH year_of AS (
  SELECT Item_Code, max(struct_pack(day := Invoice_Date, item := Item_Desc, brand := Brand)) AS newest, {dbl('sum(Amount)')} AS total,
         count(DISTINCT Customer_Name) AS customers FROM sales WHERE Invoice_Date >= {M12} GROUP BY Item_Code
), reach AS ({brand_windows("Item_Code", (12, 24, 36))}),
pattern_of AS ({item_pattern(M12)}),
risk AS (FROM ({OOS_ITEMS}) QUALIFY row_number() OVER (PARTITION BY Item_Code ORDER BY Historical_Sales DESC, Item_Desc) = 1),
channel AS (SELECT Item_Code, count(*) AS n, count_if(OOS_Risk) AS at_risk FROM ({CHANNEL_OOS}) GROUP BY Item_Code),
wide AS (SELECT Item_Code, max(Coverage_Count) FILTER (Months = 12) AS c12, max(Coverage_Count) FILTER (Months = 24) AS c24,
                max(Coverage_Count) FILTER (Months = 36) AS c36, max(Total_Sales) FILTER (Months = 36) AS s36 FROM reach GROUP BY Item_Code)
SELECT p.Item_Code AS item_code, newest.item AS item_desc, newest.brand AS brand, total AS total_sales_12m, coalesce(customers, 0) AS customer_count,
       newest.day AS last_sale_date, coalesce(c12, 0) AS coverage_12m, coalesce(c24, 0) AS coverage_24m, coalesce(c36, 0) AS coverage_36m, s36 AS sales_36m,
       p.pattern, p.planning_implication, p.months_present, risk.OOS_Risk_Level AS oos_level, risk.Historical_Sales AS oos_historical_sales,
       coalesce(n, 0) AS channels, CAST(coalesce(at_risk, 0) AS BIGINT) AS channels_at_risk
FROM pattern_of p LEFT JOIN year_of USING (Item_Code) LEFT JOIN wide USING (Item_Code) LEFT JOIN risk USING (Item_Code) LEFT JOIN channel USING (Item_Code)
"""

# The lists behind one brand's dashboard. Lists of the brand's own rows see only these; potential lost and patterns do not.
OWN = f"Brand = '{BRAND}'"
LIST_OOS = OOS_ITEMS.replace("FROM sales WHERE", f"FROM sales WHERE {OWN} AND")
LIST_SUPPLY = f"SELECT * FROM ({MULTI_ACCOUNT_OOS}) WHERE {OWN}"
LIST_LOSS = f"SELECT * EXCLUDE (Brand) FROM ({COVERAGE_LOSS}) WHERE {OWN}"
LIST_SEASONAL = f"""
SELECT p.Item_Code, c.Item_Desc, c.Brand, {dbl('c.total')} AS Total_Sales, p.pattern AS Pattern, p.peak_months AS Peak_Months, p.cv AS CV, p.seasonal_lag AS Seasonal_Lag
FROM ({item_pattern(M24)}) p JOIN (SELECT Item_Code, Item_Desc, Brand, sum(Amount) AS total FROM sales
                                  WHERE Invoice_Date >= {M24} AND {OWN} GROUP BY ALL HAVING total > 50000) c USING (Item_Code) WHERE p.is_seasonal
"""
LIST_ANOMALIES = f"""
WITH point AS (
  SELECT Item_Code, Item_Desc, Brand, strftime(Invoice_Date, '%Y-%m') AS Month, sum(Amount) AS s FROM sales WHERE Invoice_Date >= {M12} AND {OWN} GROUP BY ALL
), moment AS (
  SELECT Item_Code, count(*) AS n, CAST(sum(s) AS DOUBLE) / count(*) AS mean,
         sqrt(CAST(CAST(count(*) AS DECIMAL(20,0)) * sum(s * s) - sum(s) * sum(s) AS DOUBLE) / CAST(count(*) * count(*) AS DOUBLE)) AS std
  FROM point GROUP BY Item_Code
)
SELECT Item_Code, min(Item_Desc) OVER (PARTITION BY Item_Code) AS Item_Desc, Brand, Month, {dbl('s')} AS Sales, {rhu(f"abs({dbl('s')} - mean) / std", 6)} AS Z_Score,
       if({dbl('s')} > mean, 'Spike', 'Drop') AS Type, {rhu(f"({dbl('s')} - mean) / nullif(mean, 0) * 100.0", 2)} AS Deviation_Pct
FROM point JOIN moment USING (Item_Code) WHERE n >= 3 AND std > 0 AND abs({dbl('s')} - mean) / std > 2.5
"""

ORACLES = {
    "dashboard_oos_items": LIST_OOS,
    "dashboard_supply_issues": LIST_SUPPLY,
    "dashboard_coverage_loss": LIST_LOSS,
    "dashboard_seasonal_items": LIST_SEASONAL,
    "dashboard_anomalies": LIST_ANOMALIES,
    "item_health": ITEM_HEALTH,
    "supply_chain_dashboard": dashboard("", ALL),
    "dashboard_counts": dashboard(f"Brand = '{BRAND}'", CARDS),
}
