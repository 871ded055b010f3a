"""Rollup, dimensions and loads: same figures as from the fact, nothing else touched by a load, no repeated rows."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from salescope.operators import coverage, integrated, patterns, stock
from salescope.plans import params as P
from salescope.plans import registry
from salescope.session import checkpoint_dir
from salescope.sources import ingest, rollups
from salescope.sources.tables import TABLE_NAMES, load_tables, star_tables

from tests.helpers import make_tables, sales_row

SF = "/root/testdata/sf0.001"


def scratch(spark):
    return os.path.join(checkpoint_dir(spark), f"loads-{uuid.uuid4().hex[:8]}")


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch(spark)
    ingest.write_tables(star_tables(spark, SF), root)
    return load_tables(spark, root)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


AS_OF = dt.date(2001, 8, 1)


def odd_rows():
    """Lines that share invoice, item and day; an item with several descriptions and brands; nulls in every key."""
    rows, r = [], 0
    for code, desc, brand in (("I1", "one", "B1"), ("I1", "uno", "B1"), ("I1", "one", "B2"), ("I2", None, "B1"), (None, "x", None), ("I3", "three", None)):
        for cust in ("C1", "C2", None):
            for day in (dt.date(2000, 8, 2), dt.date(2000, 12, 5), dt.date(2001, 7, 20), dt.date(1999, 9, 9)):
                for line in range(3):
                    r += 1
                    rows.append(sales_row(day, 4000 + 7 * r, Invoice_No=None if r % 11 == 0 else 100 + r // 2, Item_Code=code, Item_Desc=desc,
                                          Brand=brand, Customer_Name=cust, Channel=["K", "L", None][line], Regular_Qty=None if r % 5 == 0 else r))
    return rows


OPERATORS = {
    "oos": lambda s, i: stock.oos_items(s, as_of=AS_OF, days_threshold=10, min_historical_sales=0),
    "oos_brand": lambda s, i: stock.oos_items(s, as_of=AS_OF, days_threshold=10, per_brand=True),
    "oos_late": lambda s, i: stock.oos_items(s, as_of=AS_OF, days_threshold=30),
    "decline": lambda s, i: stock.decline_cause(s, as_of=AS_OF, items=i),
    "channel": lambda s, i: stock.channel_oos(s, as_of=AS_OF),
    "accounts": lambda s, i: stock.multi_account_oos(s, as_of=AS_OF, min_accounts=1, days_threshold=5),
    "impact": lambda s, i: stock.oos_impact(s, as_of=AS_OF, items=i),
    "pattern": lambda s, i: patterns.item_pattern(s, as_of=AS_OF, months=24, items=i),
    "monthly": lambda s, i: patterns.item_monthly_data(s, as_of=AS_OF, months=24),
    "seasonal": lambda s, i: patterns.seasonal_items(s, as_of=AS_OF, months=80, min_sales=0),
    "stability": lambda s, i: patterns.run_rate_stability(s, as_of=AS_OF, entities=i),
    "loss": lambda s, i: coverage.coverage_loss(s, as_of=AS_OF, entity=None),
    "windows": lambda s, i: coverage.coverage_windows(s, as_of=AS_OF, level="item"),
    "company": lambda s, i: coverage.coverage_windows(s, as_of=AS_OF),
    "health": lambda s, i: integrated.item_health(s, as_of=AS_OF, items=i),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_rollup_gives_the_figures_of_the_fact(spark, name):
    t = make_tables(spark, odd_rows())
    same(OPERATORS[name](t.item_days, t.items), OPERATORS[name](t.sales, None))


def test_out_of_stock_against_a_plain_search(spark):
    """Recent sales meet history on the item's code, whatever description or brand: rows fan out."""
    rows = odd_rows()
    t = make_tables(spark, rows)
    c12, cd = dt.date(2000, 8, 1), dt.date(2001, 7, 22)
    names = t.sales.columns
    all_ = [dict(zip(names, r)) for r in rows]
    key = lambda r: (r["Item_Code"], r["Item_Desc"], r["Brand"])
    want = []
    for k in {key(r) for r in all_}:
        hist = [r for r in all_ if key(r) == k and c12 <= r["Invoice_Date"] < cd]
        recent = {}
        for r in all_:
            if r["Item_Code"] is not None and r["Item_Code"] == k[0] and r["Invoice_Date"] >= cd:
                recent.setdefault(key(r), []).append(r)
        total = sum(r["Amount"] for r in hist)
        if not hist or total <= 10000:
            continue
        for group in list(recent.values()) or [[]]:
            now = float(sum(r["Amount"] for r in group))
            if now < float(total) / len(hist) * 0.3:
                want.append((*k, float(total), len({r["Customer_Name"] for r in hist} - {None}), len({r["Invoice_No"] for r in hist} - {None}), now))
    got = stock.oos_items(t.item_days, as_of=AS_OF, days_threshold=10).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.Item_Code, r.Item_Desc, r.Brand, r.Historical_Sales, r.Affected_Accounts, r.Historical_Transactions, r.Recent_Sales)) for r in got)
    assert want


def lines_read_by(spark, key):
    """How often the plan of a query over unstored tables reads the lines."""
    return plan(registry.run_on(make_tables(spark, odd_rows()), spark, key, SF)).count("Scan ExistingRDD")


def test_dashboards_join_the_star_once(spark):
    """All lists read one rollup, written once; only the list of brands still reads the lines."""
    for key in ("supply_chain_dashboard", "dashboard_counts"):
        assert lines_read_by(spark, key) == 1, key


def test_dashboard_of_a_written_rollup(spark):
    t = make_tables(spark, odd_rows())
    days = t.days_of(AS_OF, integrated.DASHBOARD_MONTHS)
    same(days, t.item_days)  # the rows are younger
    same(integrated.supply_chain_dashboard(days, as_of=AS_OF, days_threshold=10, items=t.items),
         integrated.supply_chain_dashboard(t.sales, as_of=AS_OF, days_threshold=10))
    assert {r.Invoice_Date for r in t.days_of(AS_OF, 12).collect()} == {dt.date(2000, 8, 2), dt.date(2000, 12, 5), dt.date(2001, 7, 20)}


def test_item_health_joins_the_star_once(spark):
    """All parts read one rollup, written once; the list of items is read before, and written with the patterns."""
    assert lines_read_by(spark, "item_health") == 0


def test_coverage_against_a_plain_count(spark):
    """A member without a name has amounts but is not counted."""
    t = make_tables(spark, odd_rows())
    all_ = [dict(zip(t.sales.columns, r)) for r in odd_rows()]
    want = []
    for code in ("I1", "I2", "I3"):
        for m, cut in ((12, dt.date(2000, 8, 1)), (24, dt.date(1999, 8, 1))):
            own = [r for r in all_ if r["Item_Code"] == code and r["Invoice_Date"] >= cut]
            want.append((code, m, len({r["Customer_Name"] for r in own} - {None}), float(sum(r["Amount"] for r in own)), len({r["Invoice_No"] for r in own} - {None})))
    for rows in (t.sales, t.item_days):
        got = coverage.coverage_windows(rows, as_of=AS_OF, level="item", time_windows=(12, 24)).collect()
        assert sorted((r.Item_Code, r.Months, r.Coverage_Count, r.Total_Sales, r.Transaction_Count) for r in got) == want


def files(root, table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{table}/**/*.parquet", recursive=True)}


def test_a_load_changes_its_own_partitions_only_and_only_once(spark, tables):
    whole = tables.sales.cache()
    root, other = scratch(spark), scratch(spark)
    parts = {y: whole.filter(F.col("Year") == y) for y in (1998, 1999, 2000)}
    for r, order in ((root, (1998, 1999, 2000, 1999, 1998)), (other, (2000, 1999, 1998, 2000))):
        added = [ingest.append_load(spark, r, "sales", parts[y], f"{y} Sales") for y in order]
        assert added == [True] * 3 + [False] * (len(order) - 3)
        assert ingest.append_load(spark, r, "target", tables.target.filter(F.col("Year").isin(1998, 1999, 2000)), "Targets")
    want = whole.filter(F.col("Year").isin(1998, 1999, 2000))
    for r in (root, other):
        t = load_tables(spark, r)
        same(t.sales.select(*want.columns), want)
        same(t.item_days, rollups.item_days(want).select(*t.item_days.columns))
        same(t.items, rollups.items(want).select(*t.items.columns))
        same(t.accounts, rollups.accounts(want).select(*t.accounts.columns))
        assert t.sales_summary.agg(F.sum("Transaction_Count")).first()[0] == want.count()
        assert ingest.loads(spark, r).count() == 4

    before = {n: files(root, n) for n in (*TABLE_NAMES, "item_days", "items", "accounts")}
    more = whole.filter(F.col("Year") == 2000).limit(50)
    assert ingest.append_load(spark, root, "sales", more, "late 2000")
    for name, old in before.items():
        now = files(root, name)
        kept = {f: m for f, m in old.items() if "Year=2000" not in f or name == "sales" or "target" in name}
        assert kept.items() <= now.items() and (now == old) == ("target" in name), name
    assert load_tables(spark, root).item_days.agg(F.sum("Lines")).first()[0] == want.count() + 50
    whole.unpersist()


def test_a_load_that_stopped_halfway_is_repeated(spark, tables, monkeypatch):
    root = scratch(spark)
    year = tables.sales.filter(F.col("Year") == 1999)
    with monkeypatch.context() as m:
        m.setattr(ingest, "refresh", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest.append_load(spark, root, "sales", year, "1999 Sales")
    assert ingest.append_load(spark, root, "sales", year, "1999 Sales")
    assert spark.read.parquet(f"{root}/sales").count() == spark.read.parquet(f"{root}/item_days").agg(F.sum("Lines")).first()[0] == year.count()


@pytest.fixture
def static(spark):
    """Plans as they are before run-time changes, so that reused exchanges show."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return text.count("Exchange ") - text.count("ReusedExchange ")


def scans(text, table):
    return [line for line in text.split("\n") if "FileScan" in line and f"/{table}]" in line.replace("%", "")]


def test_listing_reads_dimensions(spark, stored, static):
    for key in ("oos_impact", "decline_cause", "item_pattern", "run_rate_stability", "q_brand", "q_auto_context", "q_item", "q_route", "never_bought_brand"):
        text = plan(registry.run_on(stored, spark, key, SF))
        assert not scans(text, "sales"), key


def test_scans_of_the_reports(spark, stored, static):
    for key, most in (("oos_items", 1), ("multi_account_oos", 1), ("seasonal_items", 1), ("item_health", 5), ("supply_chain_dashboard", 6), ("dashboard_counts", 5)):
        text = plan(registry.run_on(stored, spark, key, SF))
        read = scans(text, "item_days")
        assert not scans(text, "sales") and 1 <= len(read) <= most, (key, len(read))
        unpruned = [s for s in read if "(Year#" not in s.split("PartitionFilters")[1].split("PushedFilters")[0]]
        assert not unpruned, key


def test_coverage_loss_reads_history_only_for_lost_members(spark, stored, static):
    text = plan(registry.run_on(stored, spark, "coverage_loss", SF))
    assert "Expand" not in text and "LeftSemi" in text


def test_quantile_exchanges(spark, stored, static):
    """Besides the view, read once and shared: sketch, its row, counted values, running sums, and two one-row results."""
    from salescope.operators import targets
    for key, view in (("salesman_gap_quadrants", targets.salesman_performance), ("high_value_accounts_below_target", targets.account_performance)):
        own = exchanges(plan(view(stored, year=P.REPORT_YEAR, ordered=False)))
        text = plan(registry.run_on(stored, spark, key, SF))
        assert exchanges(text) - own <= 10, key  # six of the quantile, the rest of the report's own counts
        assert len(scans(text, "target_summary")) == 1, key
