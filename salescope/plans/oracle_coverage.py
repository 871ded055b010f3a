"""DuckDB oracle text for coverage (C1-C5): one query per window and literal anti/inner joins."""

from salescope.plans.oracle_base import AS_OF_SQL, big, dbl, months_ago
from salescope.plans.params import BRAND, BRAND2

WINDOWS = (12, 24, 36, 48)
M = {m: months_ago(m) for m in WINDOWS}


def company_windows() -> str:
    return "\nUNION ALL\n".join(f"""
SELECT '{m}M' AS Time_Window, CAST({m} AS INTEGER) AS Months, COUNT(DISTINCT Customer_Name) AS Coverage_Count,
       {dbl('SUM(Amount)')} AS Total_Sales, COUNT(DISTINCT Invoice_No) AS Transaction_Count
FROM sales WHERE Invoice_Date >= {M[m]}""" for m in WINDOWS)


def brand_windows(col: str = "Brand", windows=WINDOWS) -> str:
    lo = months_ago(max(windows))
    return "\nUNION ALL\n".join(f"""
SELECT {col}, '{m}M' AS Time_Window, CAST({m} AS INTEGER) AS Months,
       COUNT(DISTINCT CASE WHEN Invoice_Date >= {months_ago(m)} THEN Customer_Name END) AS Coverage_Count,
       {dbl(f'SUM(CASE WHEN Invoice_Date >= {months_ago(m)} THEN Amount END)')} AS Total_Sales,
       COUNT(DISTINCT CASE WHEN Invoice_Date >= {months_ago(m)} THEN Invoice_No END) AS Transaction_Count
FROM sales WHERE Invoice_Date >= {lo} AND {col} IS NOT NULL GROUP BY {col}""" for m in windows)


BRAND_VS_COMPANY = f"""
SELECT 'Brand (' || Brand || ')' AS Type, Time_Window, Months, Coverage_Count, Total_Sales, Transaction_Count
FROM ({brand_windows()}) b
UNION ALL
SELECT 'Company' AS Type, * FROM ({company_windows()}) c
"""

# A member is lost if some purchase lies in the second year back and none is younger.
COVERAGE_LOSS = f"""
SELECT Brand, Customer_Name, max(Invoice_Date) AS Last_Purchase_Date, {dbl('sum(Amount)')} AS Historical_Sales,
       {big('sum(Regular_Qty)')} AS Historical_Qty, count(DISTINCT Invoice_No) AS Historical_Transactions,
       count(DISTINCT Item_Code) AS Items_Bought, CAST({AS_OF_SQL} - max(Invoice_Date) AS INTEGER) AS Days_Since_Last_Purchase
FROM sales WHERE Brand IS NOT NULL AND Customer_Name IS NOT NULL
GROUP BY Brand, Customer_Name
HAVING max(Invoice_Date) < {M[12]} AND max(Invoice_Date) >= {M[24]}
"""

COMPARISON = f"""
SELECT '{BRAND}' AS brand1, '{BRAND2}' AS brand2, c1 AS brand1_coverage, c2 AS brand2_coverage, u AS either_brand,
       c1 + c2 - u AS overlap, u - c2 AS brand1_exclusive, u - c1 AS brand2_exclusive
FROM (
  SELECT COUNT(DISTINCT CASE WHEN Brand = '{BRAND}' THEN Customer_Name END) AS c1,
         COUNT(DISTINCT CASE WHEN Brand = '{BRAND2}' THEN Customer_Name END) AS c2,
         COUNT(DISTINCT Customer_Name) AS u
  FROM sales WHERE Brand IN ('{BRAND}', '{BRAND2}') AND Invoice_Date >= {M[12]}) x
"""

# From each member's first and last date of the two years: both in this year, both in the year before, or one in each.
NEW_LOST_RETAINED = f"""
SELECT Brand, count_if(first_day >= {M[12]}) AS New_Customers, count_if(last_day < {M[12]}) AS Lost_Customers,
       count_if(first_day < {M[12]} AND last_day >= {M[12]}) AS Retained_Customers
FROM (SELECT Brand, Customer_Name, min(Invoice_Date) AS first_day, max(Invoice_Date) AS last_day
      FROM sales WHERE Invoice_Date >= {M[24]} AND Brand IS NOT NULL AND Customer_Name IS NOT NULL GROUP BY ALL)
GROUP BY Brand
"""

ORACLES = {
    "coverage_windows": company_windows(),
    "coverage_windows_brand": brand_windows(),
    "coverage_windows_item": brand_windows("Item_Code", (12, 24, 36)),
    "coverage_brand_vs_company": BRAND_VS_COMPANY,
    "coverage_loss": COVERAGE_LOSS,
    "coverage_comparison": COMPARISON,
    "new_lost_retained": NEW_LOST_RETAINED,
}
