"""Hand-made micro-frames with the full sales / target schema."""

import datetime as dt
from decimal import Decimal

from salescope.sources.schema import SALES, TARGET
from salescope.sources.tables import Tables

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

DEFAULTS = dict(Invoice_No=1, Invoice_Type="F", Item_Code="ITM-1", Item_Desc="Item 1", Regular_Qty=1, Bonus_Qty=0,
                Brand="B1", Brand_Mask="PROMO B1", Salesman="S1", Manager="M1", GM="G1", Customer_Name="C1",
                Group="N1", Emirate="E1", Channel="CH1")


def sales_row(d: dt.date, amount, **kw):
    r = dict(DEFAULTS)
    r.update(kw)
    r.update(Year=d.year, Month_and_Year=f"{MONTHS[d.month - 1]} {d.year}", Month_and_Year_Sort=d.year * 100 + d.month,
             Invoice_Date=d, Amount=Decimal(str(amount)).quantize(Decimal("0.01")))
    return tuple(r[f.name] for f in SALES.fields)


def target_row(d: dt.date, target, **kw):
    r = dict(DEFAULTS)
    r.update(kw)
    r.update(Year=d.year, Month_and_Year=f"{MONTHS[d.month - 1]} {d.year}", Month_and_Year_Sort=d.year * 100 + d.month,
             Target=Decimal(str(target)).quantize(Decimal("0.01")))
    return tuple(r[f.name] for f in TARGET.fields)


def make_tables(spark, sales_rows, target_rows=()):
    s = spark.createDataFrame(list(sales_rows), SALES)
    t = spark.createDataFrame(list(target_rows), TARGET)
    return Tables.from_facts(s, t)


def add_months(d: dt.date, n: int) -> dt.date:
    m = d.month - 1 + n
    return dt.date(d.year + m // 12, m % 12 + 1, min(d.day, 28))
