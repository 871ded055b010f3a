"""Hand-made micro-frames for band edges and the X-rules, plus metamorphic invariants on sf0.001."""

import datetime as dt

from pyspark.sql import functions as F

from salescope.functions import dates
from salescope.operators import coverage, growth, reports, stock, targets
from tests.helpers import make_tables, sales_row, target_row

D = dt.date(2000, 1, 10)


def test_target_fan_out_literal_and_dedup(spark):
    # One customer bought brand B through two channels in one month; one target row for that 4-key.
    t = make_tables(spark,
                    [sales_row(D, 60, Channel="Retail"), sales_row(D, 40, Channel="Hospital")],
                    [target_row(D, 100, Channel="Retail")])
    lit = targets.brand_performance(t, year=2000).collect()[0]
    assert (lit["Sales"], lit["Target"]) == (100.0, 200.0)  # the literal join counts the target twice
    dd = targets.brand_performance(t, year=2000, dedup_targets=True).collect()[0]
    assert (dd["Sales"], dd["Target"], dd["Achievement"], dd["Gap"]) == (100.0, 100.0, 100.0, 0.0)
    acc = {r["Channel"]: r["Target"] for r in targets.account_performance(t, year=2000, dedup_targets=True).collect()}
    assert sorted(acc.values()) == [0.0, 100.0]


def test_zero_or_missing_target_gives_zero_achievement_and_critical(spark):
    t = make_tables(spark,
                    [sales_row(D, 500, Customer_Name="A"), sales_row(D, 500, Customer_Name="Z")],
                    [target_row(D, 0, Customer_Name="Z")])
    ap = targets.account_performance(t, year=2000)
    ach = {r["Customer_Name"]: (r["Target"], r["Achievement"]) for r in ap.collect()}
    assert ach == {"A": (0.0, 0.0), "Z": (0.0, 0.0)}
    health = {r["Category"]: r["Count"] for r in reports.account_health(ap).collect()}
    assert health == {"Healthy": 0, "At Risk": 0, "Critical": 2}


def test_size_and_health_band_edges(spark):
    sales = [(c, s) for c, s in [("a", "10000"), ("b", "10000.01"), ("c", "0"), ("d", "-5"), ("e", "50000"),
                                  ("f", "200000"), ("g", "1000000"), ("h", "1000000.01")]]
    t = make_tables(spark, [sales_row(D, s, Customer_Name=c) for c, s in sales],
                    [target_row(D, 1, Customer_Name=c) for c, _ in sales])
    sizes = {r["Category"]: r["Count"] for r in reports.account_size_distribution(
        targets.account_performance(t, year=2000)).collect()}
    # Right-closed bins: 10,000 is Micro, 50,000 Small, 200,000 Medium, 1,000,000 Large; <= 0 unclassified.
    assert sizes == {"Micro (<10K)": 1, "Small (10-50K)": 2, "Medium (50-200K)": 1, "Large (200K-1M)": 1,
                     "Enterprise (>1M)": 1}
    t2 = make_tables(spark, [sales_row(D, v, Customer_Name=c) for c, v in [("x", 50), ("y", "49.99"), ("z", 100)]],
                     [target_row(D, 100, Customer_Name=c) for c in "xyz"])
    health = {r["Category"]: r["Count"] for r in reports.account_health(
        targets.account_performance(t2, year=2000)).collect()}
    assert health == {"Healthy": 1, "At Risk": 1, "Critical": 1}


def test_growth_classes_and_percentages(spark):
    y1, y2 = dt.date(1999, 3, 1), dt.date(2000, 3, 1)
    rows = [sales_row(y2, 100, Item_Desc="new"), sales_row(y1, 100, Item_Desc="gone"),
            sales_row(y1, 100, Item_Desc="down"), sales_row(y2, 50, Item_Desc="down"),
            sales_row(y1, 100, Item_Desc="up"), sales_row(y2, 150, Item_Desc="up"),
            sales_row(y1, 100, Item_Desc="flat"), sales_row(y2, 100, Item_Desc="flat")]
    s = make_tables(spark, rows).sales
    cls = {r["Item_Desc"]: r["Class"] for r in growth.growth_classes(s, brand="B1", year1=1999, year2=2000).collect()}
    assert cls == {"new": "new", "gone": "discontinued", "down": "declining", "up": "growing"}
    flags = {r["Item_Desc"]: (r["Is_New"], r["Is_Growing"]) for r in
             growth.growth_flags(s, brand="B1", year1=1999, year2=2000).collect()}
    assert flags["new"] == (True, True)  # overlapping sets: new items are also growing
    pct = {r["Item_Desc"]: r["Growth_Pct"] for r in growth.item_growth(s, brand="B1", year1=1999, year2=2000).collect()}
    assert pct["new"] == 0.0 and pct["down"] == -50.0  # pandas path: y1 = 0 gives 0
    c = {r["Item_Desc"]: r["Growth_Pct"] for r in growth.contribution(
        s, "Item_Desc", brand="B1", year1=1999, year2=2000).collect()}
    assert c["new"] is None and c["up"] == 50.0  # SQL path: y1 = 0 gives NULL
    order = [r["Item_Desc"] for r in growth.contribution(
        s, "Item_Desc", brand="B1", year1=1999, year2=2000, focus="growing").collect()]
    assert order[0] == "new" and order[-1] == "gone"
    one_year = growth.overview_summary(s.filter(F.col("Year") == 2000), brand="B1", year1=1999, year2=2000).collect()[0]
    assert (one_year["Total_y2"], one_year["Growth_Value"], one_year["Growth_Pct"]) == (400.0, 0.0, 0.0)


def test_month_end_cutoff_clamps(spark):
    d = spark.range(1).select(dates.months_ago(dt.date(2001, 3, 31), 1).alias("c")).collect()[0]["c"]
    assert d == dt.date(2001, 2, 28)


def test_oos_fan_out_on_item_code_only(spark):
    # One item code with two descriptions: the recent side joins on Item_Code only.
    asof = dt.date(2001, 8, 1)
    rows = [sales_row(dt.date(2001, 1, 5), 20000, Item_Desc="d1"), sales_row(dt.date(2001, 2, 5), 20000, Item_Desc="d2"),
            sales_row(dt.date(2001, 7, 25), 10, Item_Desc="d1"), sales_row(dt.date(2001, 7, 26), 10, Item_Desc="d2")]
    s = make_tables(spark, rows).sales
    assert stock.oos_items(s, as_of=asof).count() == 4
    assert stock.oos_items(s, as_of=asof, per_brand=True).count() == 4


def test_coverage_invariants_and_pinned_counts(spark, tables):
    asof = dt.date(2001, 8, 1)
    win = {(r["Brand"], r["Months"]): r["Coverage_Count"] for r in
           coverage.coverage_windows(tables.sales, as_of=asof, level="brand").collect()}
    loss = {r["Brand"]: r["n"] for r in coverage.coverage_loss(tables.sales, as_of=asof, entity=None)
            .groupBy("Brand").agg(F.count(F.lit(1)).alias("n")).collect()}
    nlr = {r["Brand"]: r for r in coverage.new_lost_retained(tables.sales, as_of=asof, entity=None).collect()}
    for b, r in nlr.items():
        assert loss.get(b, 0) == win[(b, 24)] - win[(b, 12)]
        assert r["New_Customers"] + r["Retained_Customers"] == win[(b, 12)]
        assert r["Lost_Customers"] == loss.get(b, 0)
    assert [win[("Brand#1", m)] for m in (12, 24, 36, 48)] == [26, 44, 66, 83]
    one = nlr["Brand#1"]
    assert (one["New_Customers"], one["Lost_Customers"], one["Retained_Customers"]) == (23, 18, 3)
    single = coverage.coverage_windows(tables.sales, as_of=asof, level="brand", entity="Brand#1")
    assert [r["Coverage_Count"] for r in single.orderBy("Months").collect()] == [26, 44, 66, 83]


def test_recency_form_equals_per_window_distinct_counts(spark, tables):
    asof = dt.date(2001, 8, 1)
    rec = {r["Months"]: (r["Coverage_Count"], r["Total_Sales"], r["Transaction_Count"])
           for r in coverage.coverage_windows(tables.sales, as_of=asof).collect()}
    for m in (12, 24, 36, 48):
        lit = tables.sales.filter(F.col("Invoice_Date") >= dates.months_ago(asof, m)).agg(
            F.countDistinct("Customer_Name"), F.sum("Amount").cast("double"), F.countDistinct("Invoice_No")).collect()[0]
        assert rec[m] == tuple(lit)


def test_dashboard_single_brand_equals_all_brand_row(spark, tables):
    from salescope.operators import integrated

    asof = dt.date(2001, 8, 1)
    allb = {r["brand"]: r.asDict() for r in integrated.supply_chain_dashboard(tables.sales, as_of=asof).collect()}
    one = integrated.supply_chain_dashboard(tables.sales, as_of=asof, brand="Brand#1").collect()[0].asDict()
    assert one == allb["Brand#1"]
    parts = integrated.supply_chain_parts(tables.sales, as_of=asof, brand="Brand#1")
    assert {f"{k}_count": v.count() for k, v in parts.items()} == {k: v for k, v in one.items() if k != "brand"}
