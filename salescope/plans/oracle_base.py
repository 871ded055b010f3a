"""Shared text for the DuckDB oracle queries.

The oracle sees only the raw star-schema views, so every oracle query is wrapped in a prelude
that derives ``sales``, ``target``, ``sales_summary`` and ``target_summary`` the same way the
fixture does, written independently in DuckDB SQL.
"""

from __future__ import annotations

from salescope.plans.params import AS_OF_SQL

PRELUDE = """
star AS (
  SELECT l.l_linenumber, o.o_orderkey, CAST(o.o_orderdate AS DATE) AS d, l.l_quantity, l.l_discount,
         l.l_extendedprice, p.p_partkey, p.p_name, p.p_brand, p.p_type, s.s_name, sn.n_name AS s_nation,
         sr.r_name AS s_region, c.c_name, cn.n_name AS c_nation, cr.r_name AS c_region, c.c_mktsegment,
         o.o_orderstatus
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey
),
sales AS (
  SELECT CAST(year(d) AS INTEGER) AS "Year", strftime(d, '%b %Y') AS Month_and_Year,
         CAST(year(d) * 100 + month(d) AS INTEGER) AS Month_and_Year_Sort, d AS Invoice_Date,
         CAST(o_orderkey AS BIGINT) AS Invoice_No, o_orderstatus AS Invoice_Type,
         'ITM-' || CAST(p_partkey AS VARCHAR) AS Item_Code, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS Item_Desc,
         CAST(l_quantity AS BIGINT) AS Regular_Qty, CAST(floor(l_quantity * l_discount) AS BIGINT) AS Bonus_Qty,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS Amount, p_brand AS Brand, p_type || ' ' || p_brand AS Brand_Mask,
         s_name AS Salesman, s_nation AS Manager, s_region AS GM, c_name AS Customer_Name, c_nation AS "Group",
         c_region AS Emirate, c_mktsegment AS Channel
  FROM star
),
target AS (
  SELECT CAST(year(d) AS INTEGER) AS "Year", strftime(d, '%b %Y') AS Month_and_Year,
         CAST(year(d) * 100 + month(d) AS INTEGER) AS Month_and_Year_Sort, p_brand AS Brand, s_name AS Salesman,
         s_nation AS Manager, s_region AS GM, c_region AS Emirate, c_mktsegment AS Channel, c_name AS Customer_Name,
         CAST(CAST((CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)
                     * (40 + (7 * o_orderkey + 13 * l_linenumber) % 200)
                     * [50, 75, 100, 150][CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 + 1]
                     * [60, 80, 100, 120, 200][CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) % 5 + 1]
                     + 500000) // 1000000 AS DECIMAL(18,0))
              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS Target
  FROM star
),
sales_summary AS (
  SELECT "Year", Month_and_Year, Month_and_Year_Sort, Brand, Salesman, Manager, GM, Emirate, Channel, Customer_Name,
         SUM(Amount) AS Total_Amount, SUM(Regular_Qty) AS Total_Qty, SUM(Bonus_Qty) AS Total_Bonus,
         COUNT(*) AS Transaction_Count
  FROM sales GROUP BY ALL
),
target_summary AS (
  SELECT Month_and_Year, Month_and_Year_Sort, Brand, Salesman, Manager, GM, Emirate, Channel, Customer_Name,
         SUM(Target) AS Total_Target
  FROM target GROUP BY ALL
)
"""


def wrap(body: str) -> str:
    return f"WITH {PRELUDE} SELECT * FROM ({body}) AS q"


def months_ago(n: int) -> str:
    return f"CAST({AS_OF_SQL} - INTERVAL {int(n)} MONTH AS DATE)"


def days_ago(n: int) -> str:
    return f"CAST({AS_OF_SQL} - INTERVAL {int(n)} DAY AS DATE)"


def rhu(expr: str, digits: int) -> str:
    """Same IEEE rounding as ``series.round_half_up``."""
    scale = float(10 ** digits)
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + 0.5) / {scale})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def safe_div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"
