"""Coverage reach: rolling windows, lost accounts, brand comparison, new / lost / retained.

Recency reduction: a member is covered in a window starting at ``cutoff`` iff its last purchase
is on or after ``cutoff``. So each operator aggregates once per member (max date plus flags) and
then counts members per window with conditional counts. That replaces one COUNT(DISTINCT) per
window (a multi-way expansion of the fact) by one shuffle of partially aggregated rows per grain;
a member holding a large share of rows is collapsed map-side by the partial aggregate.

``entity=None`` at brand or item level runs the operator for every brand / item at once, with
the entity column as an extra key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions import dates
from salescope.functions.expr import apply_filters, dim, money
from salescope.sources import rollups

DEFAULT_WINDOWS = (12, 24, 36, 48)
LEVEL_COLUMN = {"brand": "Brand", "item": "Item_Code"}


def _scope(sales: DataFrame, level: str, entity: str | None, filters: dict | None) -> tuple[DataFrame, list[str]]:
    if level == "company":
        return apply_filters(sales, filters), []
    col = LEVEL_COLUMN[level]
    if entity is None:
        return apply_filters(sales.filter(F.col(col).isNotNull()), filters), [col]
    return apply_filters(sales.filter(F.col(col) == F.lit(entity)), filters), []


def _agg(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def coverage_windows(sales: DataFrame, *, as_of, level: str = "company", entity: str | None = None,
                     time_windows=DEFAULT_WINDOWS, dimension: str = "Customer_Name",
                     filters: dict | None = None) -> DataFrame:
    """Per window: distinct members of ``dimension``, SUM(Amount), distinct invoices.

    ``sales`` is the fact or, where the entity and the members are among its keys, the ``item_days`` rollup."""
    member = dim(dimension)
    windows = [int(m) for m in time_windows]
    base, keys = _scope(sales, level, entity, filters)
    cut = {m: dates.months_ago(as_of, m) for m in windows}
    base = dates.since(base, dates.months_ago(as_of, max(windows)))
    d = F.col("Invoice_Date")
    # One scan: each row counts for its member, which may be null and has its amounts, and for its invoices.
    kinds = F.concat(F.array(F.struct(F.lit("member").alias("_kind"), F.col(member).cast("string").alias("_id"))),
                     rollups.counted(base, {"invoice": rollups.invoices(base)}))
    each = base.select(*keys, d.alias("_d"), "Amount", F.explode(kinds).alias("_k")).select(*keys, "_d", "Amount", "_k.*")
    last, own = F.col("_last"), F.col("_kind") == "member"
    per = each.groupBy(*keys, "_kind", "_id").agg(
        F.max("_d").alias("_last"), *[F.sum(F.when(own & (F.col("_d") >= cut[m]), F.col("Amount"))).alias(f"_a{m}") for m in windows])

    def in_window(kind: str, m: int) -> Column:
        return F.count(F.when((F.col("_kind") == kind) & F.col("_id").isNotNull() & (last >= cut[m]), 1))

    j = _agg(per, keys, *[in_window("member", m).alias(f"_c{m}") for m in windows], *[in_window("invoice", m).alias(f"_t{m}") for m in windows],
             *[F.sum(f"_a{m}").alias(f"_s{m}") for m in windows])
    rows = F.array(*[
        F.struct(
            F.lit(f"{m}M").alias("Time_Window"),
            F.lit(m).cast("int").alias("Months"),
            F.coalesce(F.col(f"_c{m}"), F.lit(0)).cast("bigint").alias("Coverage_Count"),
            money(F.col(f"_s{m}")).alias("Total_Sales"),
            F.coalesce(F.col(f"_t{m}"), F.lit(0)).cast("bigint").alias("Transaction_Count"),
        ) for m in windows])
    return j.select(*keys, F.inline(rows))


def coverage_brand_vs_company(sales: DataFrame, *, as_of, brand: str | None, time_windows=DEFAULT_WINDOWS) -> DataFrame:
    """Brand coverage and company coverage side by side, tagged with ``Type``.

    With ``brand=None`` every brand's windows are listed ('Brand (<name>)') with the company's.
    """
    b = coverage_windows(sales, as_of=as_of, level="brand", entity=brand, time_windows=time_windows)
    if brand is None:
        b = b.select(F.concat(F.lit("Brand ("), F.col("Brand"), F.lit(")")).alias("Type"),
                     *[c for c in b.columns if c != "Brand"])
    else:
        b = b.withColumn("Type", F.lit(f"Brand ({brand})"))
    c = coverage_windows(sales, as_of=as_of, level="company", time_windows=time_windows).withColumn(
        "Type", F.lit("Company"))
    return b.unionByName(c)


def _loss_scope(sales: DataFrame, entity: str | None, entity_type: str, dimension: str) -> tuple[DataFrame, list[str]]:
    """The entity's rows with a member, and the keys: (entity,) member."""
    member, ent = dim(dimension), dim(entity_type)
    base = sales.filter(F.col(member).isNotNull())
    if entity is None:
        return base.filter(F.col(ent).isNotNull()), [ent, member]
    return base.filter(F.col(ent) == F.lit(entity)), [member]


def lost_members(sales: DataFrame, *, as_of, entity: str | None, entity_type: str = "Brand", recent_months: int = 12,
                 historical_months: int = 24, dimension: str = "Customer_Name") -> DataFrame:
    """Who bought in [now-hist, now-recent) but not since, from the pruned window alone."""
    base, keys = _loss_scope(sales, entity, entity_type, dimension)
    c_recent, c_hist = dates.months_ago(as_of, recent_months), dates.months_ago(as_of, historical_months)
    last = dates.since(base, F.least(c_hist, c_recent)).groupBy(*keys).agg(F.max("Invoice_Date").alias("_last"))
    return last.filter((F.col("_last") < c_recent) & (F.col("_last") >= c_hist)).select(*keys)


def coverage_loss(sales: DataFrame, *, as_of, entity: str | None, entity_type: str = "Brand",
                  recent_months: int = 12, historical_months: int = 24,
                  dimension: str = "Customer_Name", ordered: bool = True) -> DataFrame:
    """Members who bought in [now-hist, now-recent) but not since; their all-time figures.

    Whose last purchase lies between the two cut-offs is decided first, from the pruned window alone. Every measure is
    all-time, as in the reference's re-join, but only the rows of these members are kept for it (a semi-join), and a
    member's sums, invoices and items are counted in one aggregate without expanding all history. ``sales`` is the fact
    or its ``item_days`` rollup.
    """
    base, keys = _loss_scope(sales, entity, entity_type, dimension)
    gone = lost_members(sales, as_of=as_of, entity=entity, entity_type=entity_type, recent_months=recent_months,
                        historical_months=historical_months, dimension=dimension)
    theirs = base.join(gone, keys, "left_semi")
    kinds = rollups.counted(theirs, {"invoice": rollups.invoices(theirs), "item": F.col("Item_Code"), "total": F.lit("")})
    each = theirs.select(*keys, F.col("Invoice_Date").alias("_d"), "Amount", "Regular_Qty", F.explode(kinds).alias("_k")).select(*keys, "_d", "Amount", "Regular_Qty", "_k.*")
    total = F.col("_kind") == "total"
    per = each.groupBy(*keys, "_kind", "_id").agg(
        F.max("_d").alias("_d"), F.sum(F.when(total, F.col("Amount"))).alias("_sales"), F.sum(F.when(total, F.col("Regular_Qty"))).alias("_qty"))
    lost = per.groupBy(*keys).agg(
        F.max("_d").alias("Last_Purchase_Date"),
        F.sum("_sales").alias("_sales"),
        F.sum("_qty").alias("Historical_Qty"),
        F.count(F.when(F.col("_kind") == "invoice", 1)).alias("Historical_Transactions"),
        F.count(F.when(F.col("_kind") == "item", 1)).alias("Items_Bought"),
    )
    out = lost.select(
        *keys, "Last_Purchase_Date", money("_sales").alias("Historical_Sales"), "Historical_Qty",
        "Historical_Transactions", "Items_Bought",
        F.datediff(dates.as_date(as_of), F.col("Last_Purchase_Date")).alias("Days_Since_Last_Purchase"),
    )
    return out.orderBy(*keys[:-1], F.col("Historical_Sales").desc(), keys[-1]) if ordered else out


def coverage_comparison(sales: DataFrame, *, as_of, brand1: str, brand2: str, months: int = 12) -> DataFrame:
    """Coverage of two brands, the customers buying either, the true overlap and exclusives.

    ``either_brand`` is the figure the reference labels "overlap"; ``overlap`` here is the
    customers buying both (c1 + c2 - either) and the exclusives are each brand minus the other.
    """
    base = dates.since(sales.filter(F.col("Brand").isin(brand1, brand2) & F.col("Customer_Name").isNotNull()),
                       dates.months_ago(as_of, months))
    per = base.groupBy("Customer_Name").agg(
        F.max(F.when(F.col("Brand") == brand1, 1)).alias("_b1"),
        F.max(F.when(F.col("Brand") == brand2, 1)).alias("_b2"),
    )
    g = per.agg(
        F.count(F.when(F.col("_b1") == 1, 1)).alias("brand1_coverage"),
        F.count(F.when(F.col("_b2") == 1, 1)).alias("brand2_coverage"),
        F.count(F.lit(1)).alias("either_brand"),
        F.count(F.when((F.col("_b1") == 1) & (F.col("_b2") == 1), 1)).alias("overlap"),
        F.count(F.when((F.col("_b1") == 1) & F.col("_b2").isNull(), 1)).alias("brand1_exclusive"),
        F.count(F.when((F.col("_b2") == 1) & F.col("_b1").isNull(), 1)).alias("brand2_exclusive"),
    )
    return g.select(F.lit(brand1).alias("brand1"), F.lit(brand2).alias("brand2"), *g.columns)


def new_lost_retained(sales: DataFrame, *, as_of, entity: str | None, entity_type: str = "Brand",
                      period_months: int = 12) -> DataFrame:
    """C4: customers new / lost / retained, this period vs the equal period before."""
    ent = dim(entity_type)
    base = sales.filter(F.col("Customer_Name").isNotNull())
    keys: list[str] = []
    if entity is None:
        base = base.filter(F.col(ent).isNotNull())
        keys = [ent]
    else:
        base = base.filter(F.col(ent) == F.lit(entity))
    cp = dates.months_ago(as_of, period_months)
    c2p = dates.months_ago(as_of, 2 * period_months)
    d = F.col("Invoice_Date")
    per = dates.since(base, c2p).groupBy(*keys, "Customer_Name").agg(
        F.max(F.when(d >= cp, 1)).alias("_cur"),
        F.max(F.when(d < cp, 1)).alias("_prev"),
    )
    cur, prev = F.col("_cur") == 1, F.col("_prev") == 1
    return _agg(per, keys,
                F.count(F.when(cur & F.col("_prev").isNull(), 1)).alias("New_Customers"),
                F.count(F.when(prev & F.col("_cur").isNull(), 1)).alias("Lost_Customers"),
                F.count(F.when(cur & prev, 1)).alias("Retained_Customers"))
