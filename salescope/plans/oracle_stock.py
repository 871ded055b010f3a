"""DuckDB oracle text for the out-of-stock operators (O1-O5), written from the query semantics."""

from salescope.plans.oracle_base import AS_OF_SQL, big, days_ago, dbl, months_ago, rhu

D30 = days_ago(30)
D90 = days_ago(90)
M12 = months_ago(12)

# Every line of the last year is early or late; an item's verdict compares the late total with 0.3 early lines.
OOS_ITEMS = f"""
WITH span_totals AS (
  SELECT Item_Code, Item_Desc, Brand, Invoice_Date >= {D30} AS late, sum(Amount) AS total,
         CAST(sum(Amount) AS DOUBLE) / count(Amount) AS mean_line, max(Invoice_Date) AS latest,
         count(DISTINCT Customer_Name) AS accounts, count(DISTINCT Invoice_No) AS invoices, sum(Regular_Qty) AS pieces
  FROM sales WHERE Invoice_Date >= least({M12}, {D30}) GROUP BY ALL
), judged AS (
  SELECT e.*, coalesce({dbl('l.total')}, 0.0) AS late_total, l.latest AS late_date
  FROM (FROM span_totals WHERE NOT late AND total > 10000) e
  LEFT JOIN (FROM span_totals WHERE late) l USING (Item_Code)
), verdict(nothing_sold, label, advice) AS (
  VALUES (true, 'High', 'Increase forecast by 20% to recover lost sales'),
         (false, 'Medium', 'Review stock levels and pending orders')
)
SELECT Item_Code, Item_Desc, Brand, {dbl('total')} AS Historical_Sales, accounts AS Affected_Accounts,
       invoices AS Historical_Transactions, mean_line AS Avg_Monthly_Sales, {big('pieces')} AS Historical_Qty,
       late_total AS Recent_Sales, late_date AS Last_Sale_Date,
       CAST({AS_OF_SQL} - coalesce(late_date, {D30}) AS INTEGER) AS Days_Since_Sale,
       label AS OOS_Risk_Level, advice AS Forecast_Suggestion
FROM judged JOIN verdict ON nothing_sold = (late_total = 0)
WHERE late_total < mean_line * 0.3
"""

# What customers spent on an item in each of the two spans; the labels' conditions stand beside them, first fit first.
DECLINE_CAUSE = f"""
WITH slice AS (
  SELECT Item_Code, if(Invoice_Date >= {D30}, 'month', 'before') AS span, sum(Amount) AS spent, count(DISTINCT Customer_Name) AS buyers
  FROM sales WHERE Invoice_Date >= {D90} GROUP BY ALL
), figures AS (
  SELECT Item_Code, coalesce(m.spent, 0) AS m_spent, coalesce(m.buyers, 0) AS m_buyers, coalesce(b.spent, 0) AS b_spent, coalesce(b.buyers, 0) AS b_buyers
  FROM (SELECT DISTINCT Item_Code FROM sales) LEFT JOIN (FROM slice WHERE span = 'month') m USING (Item_Code)
  LEFT JOIN (FROM slice WHERE span = 'before') b USING (Item_Code)
), verdict AS (
  SELECT Item_Code, 1 AS place, 'Supply-Driven (High Probability OOS) - Sudden zero sales' AS label FROM figures WHERE m_spent = 0 AND b_spent > 1000
  UNION ALL SELECT Item_Code, 2, 'Supply-Driven (Widespread Stoppage) - All accounts stopped buying' FROM figures WHERE m_buyers = 0 AND b_buyers >= 6
  UNION ALL SELECT Item_Code, 3, 'Demand-Driven (Declining Trend) - Sales dropped but not zero' FROM figures WHERE m_spent > 0 AND b_spent > 2 * m_spent
  UNION ALL SELECT Item_Code, 4, 'Inconclusive - Needs manual check' FROM figures
)
SELECT Item_Code AS Item, arg_min(label, place) AS Cause FROM verdict GROUP BY Item_Code
"""

# A channel's last month against its eleven before; channels without sales in the eleven are left out.
CHANNEL_OOS = f"""
WITH slice AS (
  SELECT Item_Code, Channel, Invoice_Date >= {D30} AS late, sum(Amount) AS spent, count(DISTINCT Customer_Name) AS buyers
  FROM sales WHERE Invoice_Date >= {M12} GROUP BY ALL
), pair AS (
  SELECT e.Item_Code, e.Channel, e.spent AS before, e.buyers AS buyers_before, coalesce(l.spent, 0) AS after, coalesce(l.buyers, 0) AS buyers_after
  FROM (FROM slice WHERE NOT late AND spent > 0) e
  LEFT JOIN (FROM slice WHERE late) l ON l.Item_Code = e.Item_Code AND l.Channel IS NOT DISTINCT FROM e.Channel
)
SELECT Item_Code, Channel, {dbl('after')} AS Recent_Sales, {dbl('before')} AS Historical_Sales, buyers_after AS Recent_Customers,
       buyers_before AS Historical_Customers, after = 0 AS OOS_Risk,
       {rhu(f"({dbl('before')} - {dbl('after')}) / {dbl('before')} * 100.0", 2)} AS Sales_Drop_Pct
FROM pair
"""

# An account has stopped on an item if its last purchase is older than 30 days; what it spent on the item's code
# within the year is lost potential, once for every description and brand it stopped on.
MULTI_ACCOUNT_OOS = f"""
WITH spent AS (
  SELECT Item_Code, Customer_Name, sum(Amount) AS on_code FROM sales WHERE Invoice_Date >= {M12} GROUP BY ALL
), latest AS (
  SELECT Item_Code, Item_Desc, Brand, Customer_Name, max(Invoice_Date) AS day FROM sales WHERE Invoice_Date >= {M12} GROUP BY ALL
)
SELECT Item_Code, Item_Desc, Brand, count(DISTINCT Customer_Name) AS Stopped_Accounts, max(day) AS Most_Recent_Stop,
       {dbl('sum(on_code)')} AS Lost_Sales_Potential
FROM (FROM latest WHERE day < {D30}) JOIN spent USING (Item_Code, Customer_Name)
GROUP BY ALL HAVING Stopped_Accounts >= 5
"""

# Every item ever sold is listed; one that was silent for a year has no estimate.
OOS_IMPACT = f"""
WITH visit AS (
  SELECT Item_Code, Customer_Name, Invoice_Date, sum(Amount) AS spent FROM sales WHERE Invoice_Date >= {M12} GROUP BY ALL
), year_of AS (
  SELECT Item_Code, CAST(sum(spent) AS DOUBLE) / count(spent) AS mean_visit, count(DISTINCT Customer_Name) AS accounts, sum(spent) AS total
  FROM visit GROUP BY Item_Code
)
SELECT Item_Code, mean_visit * 30.0 AS Estimated_Lost_Sales, coalesce(accounts, 0) AS Affected_Customers, {dbl('total')} AS Annual_Sales
FROM (SELECT DISTINCT Item_Code FROM sales) LEFT JOIN year_of USING (Item_Code)
"""

ORACLES = {
    "oos_items": OOS_ITEMS,
    "decline_cause": DECLINE_CAUSE,
    "channel_oos": CHANNEL_OOS,
    "multi_account_oos": MULTI_ACCOUNT_OOS,
    "oos_impact": OOS_IMPACT,
}
