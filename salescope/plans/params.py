"""Pinned parameters of the registered queries (the test data spans 1995-01-01 .. 2001-08-01)."""

import datetime as dt

AS_OF = dt.date(2001, 8, 1)
AS_OF_SQL = "DATE '2001-08-01'"
YEAR1, YEAR2 = 1999, 2000
REPORT_YEAR = 2000
BRAND = "Brand#1"
BRAND2 = "Brand#13"
MASK = "promo"
DAYS = 30
ITEM_MONTHS = 80  # item-level series need a long window at this data density
