"""DuckDB oracle text for reports whose order is data (a Rank column)."""

from salescope.plans.oracle_growth import BRAND_MONTHS, CLASSES, SLICE, SPECS
from salescope.plans.oracle_base import dbl, rhu
from salescope.plans.oracle_reports import AP
from salescope.plans.oracle_stock import MULTI_ACCOUNT_OOS, OOS_ITEMS
from salescope.plans.params import YEAR1, YEAR2


def ranked(cols: str, body: str, order: str, kind: str = "BIGINT") -> str:
    return f"SELECT {cols}, CAST(row_number() OVER (ORDER BY {order}) AS {kind}) AS Rank FROM ({body}) r"


def members(part: str) -> str:
    """One breakdown of every brand, largest change first."""
    column, most, sold = SPECS[part]
    first, second = (f"coalesce(sum(Amount) FILTER (\"Year\" = {y}), 0)" for y in (YEAR1, YEAR2))
    keep = "HAVING s1 > 0 OR s2 > 0" if sold else ""
    top = f"QUALIFY row_number() OVER (PARTITION BY Brand ORDER BY s2 - s1 DESC, Member NULLS FIRST) <= {most}" if most else ""
    return f"""(SELECT Brand, '{column}' AS Dimension, "{column}" AS Member, {first} AS s1, {second} AS s2 {SLICE} GROUP BY Brand, "{column}" {keep} {top})"""


BRAND_REPORT = f"""
SELECT Brand, Dimension, Member, {dbl('s1')} AS Sales_y1, {dbl('s2')} AS Sales_y2, {dbl('s2 - s1')} AS Variance,
       {rhu(f"{dbl('s2 - s1')} / nullif({dbl('s1')}, 0) * 100.0", 2)} AS Growth_Pct
FROM ({' UNION ALL '.join(members(p) for p in SPECS)}) u
"""

ORACLES = {
    "brand_report_members": BRAND_REPORT,
    "oos_items_ranked": ranked("Item_Code, Item_Desc, Historical_Sales", OOS_ITEMS, "Historical_Sales DESC NULLS LAST, Item_Code NULLS FIRST, Item_Desc NULLS FIRST"),
    "multi_account_oos_ranked": ranked("Item_Code, Stopped_Accounts, Lost_Sales_Potential", MULTI_ACCOUNT_OOS,
                                       "Stopped_Accounts DESC, Lost_Sales_Potential DESC NULLS LAST, Item_Code NULLS FIRST"),
    "brand_months_ranked": ranked("Brand, Month_and_Year, \"Year\", Sales", BRAND_MONTHS, "Brand, strptime(Month_and_Year, '%b %Y')"),
    "growth_classes_ranked": ranked("Brand, Item_Desc, Class, Growth_Value", CLASSES,
                                    "Brand, Class, if(Class = 'growing', -Growth_Value, Growth_Value), Item_Desc"),
    "account_gaps_all": ranked("Customer_Name, Gap", f"SELECT Customer_Name, CAST(sum(CAST(Gap AS DECIMAL(38,2))) AS DOUBLE) AS Gap FROM ({AP}) a GROUP BY Customer_Name HAVING Gap > 0",
                               "Gap DESC, Customer_Name NULLS FIRST", "INTEGER"),
}
