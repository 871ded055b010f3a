"""Physical-plan properties: pruning and pushdown on the stored layout, join shapes, no Python UDFs."""

import os
import uuid

import pytest

from salescope.plans import registry
from salescope.session import checkpoint_dir
from salescope.sources.ingest import write_tables
from salescope.sources.tables import load_tables, star_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    root = os.path.join(checkpoint_dir(spark), f"plans-{uuid.uuid4().hex[:8]}")
    write_tables(star_tables(spark, SF), root)
    return load_tables(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_window_prunes_year_partitions_and_pushes_date(spark, stored):
    p = plan(registry.run_on(stored, spark, "oos_items"))
    assert "PartitionFilters: [isnotnull(Year" in p and "(Year#" in p and ">= 2000" in p
    assert "PushedFilters: [IsNotNull(Invoice_Date), GreaterThanOrEqual(Invoice_Date,2000-08-01)" in p


def test_summary_scan_reads_only_needed_columns(spark, stored):
    p = plan(registry.run_on(stored, spark, "monthly_trend"))
    schema = p[p.index("ReadSchema: "):].split("\n")[0]
    assert "Total_Amount" in schema and "Customer_Name" not in schema and "Salesman" not in schema
    assert "PartitionFilters: [isnotnull(Year" in p


def test_anti_join_for_never_bought(spark, stored):
    assert "LeftAnti" in plan(registry.run_on(stored, spark, "never_bought_brand"))


def test_no_python_udf_and_no_cartesian_product_anywhere(spark):
    for key, q in registry.queries().items():
        p = plan(q(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key
        assert "CartesianProduct" not in p, key


def test_three_key_target_join_emits_no_pairs(spark, stored):
    p = plan(registry.run_on(stored, spark, "sales_vs_target_3key"))
    assert p.count("HashAggregate") >= 4  # both sides aggregated to the 3 keys before the join


def test_targets_are_pruned_to_the_report_year(spark, stored):
    for key in ("brand_performance", "gm_performance", "salesman_performance", "account_performance", "sales_vs_target_3key"):
        scans = [line for line in plan(registry.run_on(stored, spark, key)).split("\n") if "FileScan" in line]
        assert len(scans) == 2 and all("(Year#" in s and "= 2000)" in s.split("PartitionFilters")[1] for s in scans), key


def test_item_pattern_has_no_inlined_array_lambdas_below_filters(spark, stored):
    opt = registry.run_on(stored, spark, "seasonal_items")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in opt.split("\n") if "Filter" in line]
    assert not any("lambdafunction" in f for f in filters)


def test_per_group_top_n_is_limited_before_the_shuffle(spark, stored):
    for key in ("contrib_customer", "growth_customers_top50", "salesman_categories"):
        assert plan(registry.run_on(stored, spark, key)).count("WindowGroupLimit") >= 2, key
