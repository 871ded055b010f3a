"""Map the TPC-H-like star schema in the test data onto the ``sales`` and ``target`` tables.

One ``sales`` row per ``lineitem`` row: lineitem -> orders -> customer -> nation/region (customer
side) -> part -> supplier -> nation/region (supplier side). All joins are inner equi-joins on
dimension keys; Catalyst/AQE choose broadcast (size-checked by the planner) or sort-merge per side,
so nothing here depends on a dimension staying small; only the nations are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.sources.schema import MONEY


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_read = read_table


def star_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined star rows with every column the two fact tables need, plus the order/line keys."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    # Nations and regions are fixed lists, so they are sent to the rows: the planner's estimate of their join is too large
    # for that, and all lines would be sent by one of 25 nations otherwise, however many partitions there are.
    cgeo = geo.select(F.col("n_nationkey").alias("cg_key"), F.col("n_name").alias("c_nation"),
                      F.col("r_name").alias("c_region"))
    sgeo = geo.select(F.col("n_nationkey").alias("sg_key"), F.col("n_name").alias("s_nation"),
                      F.col("r_name").alias("s_region"))
    # Orders get their customers before they get their lines, of which there are several each, and the lines their parts,
    # whose names are long, at last: so few and narrow rows are shuffled.
    bought = orders.join(cust, F.col("o_custkey") == cust.c_custkey).join(F.broadcast(cgeo), F.col("c_nationkey") == cgeo.cg_key)
    return (
        li.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supp, F.col("l_suppkey") == supp.s_suppkey)
        .join(F.broadcast(sgeo), F.col("s_nationkey") == sgeo.sg_key)
        .join(part, F.col("l_partkey") == part.p_partkey)
    )


def _dims(d: Column) -> list[Column]:
    return [
        F.year(d).cast("int").alias("Year"),
        F.date_format(d, "MMM yyyy").alias("Month_and_Year"),
        (F.year(d) * 100 + F.month(d)).cast("int").alias("Month_and_Year_Sort"),
    ]


def sales_from_star(base: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return base.select(
        *_dims(d),
        d.alias("Invoice_Date"),
        F.col("o_orderkey").cast("bigint").alias("Invoice_No"),
        F.col("o_orderstatus").alias("Invoice_Type"),
        F.concat(F.lit("ITM-"), F.col("p_partkey").cast("string")).alias("Item_Code"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("Item_Desc"),
        F.col("l_quantity").cast("bigint").alias("Regular_Qty"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("bigint").alias("Bonus_Qty"),
        F.col("l_extendedprice").cast(MONEY).alias("Amount"),
        F.col("p_brand").alias("Brand"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("Brand_Mask"),
        F.col("s_name").alias("Salesman"),
        F.col("s_nation").alias("Manager"),
        F.col("s_region").alias("GM"),
        F.col("c_name").alias("Customer_Name"),
        F.col("c_nation").alias("Group"),
        F.col("c_region").alias("Emirate"),
        F.col("c_mktsegment").alias("Channel"),
    )


# Fixed values of the target fixture: the target of a line is Amount * (40 + (7*orderkey + 13*linenumber) % 200) / 100,
# times a percentage by brand number modulo 4 and one by salesman number modulo 5, so that every band of achievement
# is met by brands and by salesmen. Every order has one.
BRAND_PCT = (50, 75, 100, 150)
SALESMAN_PCT = (60, 80, 100, 120, 200)


def target_from_star(base: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    # Amount x factor / 100, rounded half up to the cent in integer arithmetic (amounts are
    # positive), then scaled back exactly: no engine-specific decimal division involved.
    number = "CAST(regexp_extract({}, '([0-9]+)', 1) AS BIGINT)"
    pct = " * ".join(f"element_at(array({', '.join(map(str, values))}), CAST({number.format(column)} % {len(values)} AS INT) + 1)"
                     for column, values in (("p_brand", BRAND_PCT), ("s_name", SALESMAN_PCT)))
    target_cents = F.expr(
        "(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
        f" * (40 + (7 * o_orderkey + 13 * l_linenumber) % 200) * {pct} + 500000) div 1000000")
    target = (target_cents.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY)
    return base.select(
        *_dims(d),
        F.col("p_brand").alias("Brand"),
        F.col("s_name").alias("Salesman"),
        F.col("s_nation").alias("Manager"),
        F.col("s_region").alias("GM"),
        F.col("c_region").alias("Emirate"),
        F.col("c_mktsegment").alias("Channel"),
        F.col("c_name").alias("Customer_Name"),
        target.alias("Target"),
    )
