"""Registered queries: one entry per operator key, each ``(spark, sf_dir) -> DataFrame``.

Every entry derives the four tables from the given star-schema parquet (lazily; only the joins a
query needs are planned) and runs one operator over the whole tables with the pinned parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.operators import (coverage, growth, integrated, patterns, questions, reports, sqlsurface, stock,
                                 targets)
from salescope.functions.rank import global_rank
from salescope.plans import params as P
from salescope.session import written
from salescope.sources import catalog
from salescope.sources.questions import questions_table
from salescope.sources.tables import Tables, star_tables

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[Tables, SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        _REGISTRY[key] = fn
        return fn
    return deco


def _bind(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star_tables(spark, sf_dir), spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries() -> dict[str, Query]:
    return {k: _bind(v) for k, v in _REGISTRY.items()}


def run_on(tables: Tables, spark: SparkSession, key: str, sf_dir: str = "") -> DataFrame:
    """Run one registered operator on already-loaded tables (used by the bench)."""
    return _REGISTRY[key](tables, spark, sf_dir)


# ---- out-of-stock -------------------------------------------------------------------------------
register("oos_items")(lambda t, s, d: stock.oos_items(t.item_days, as_of=P.AS_OF, days_threshold=P.DAYS))
register("decline_cause")(lambda t, s, d: stock.decline_cause(t.item_days, as_of=P.AS_OF, items=t.items))
register("channel_oos")(lambda t, s, d: stock.channel_oos(t.item_days, as_of=P.AS_OF, days_threshold=P.DAYS))
register("multi_account_oos")(lambda t, s, d: stock.multi_account_oos(t.item_days, as_of=P.AS_OF))
register("oos_impact")(lambda t, s, d: stock.oos_impact(t.item_days, as_of=P.AS_OF, oos_days=P.DAYS, items=t.items))

# ---- marts and catalog --------------------------------------------------------------------------
register("sales_summary")(lambda t, s, d: t.sales_summary.select(
    *[c for c in t.sales_summary.columns if c not in ("Total_Amount",)],
    t.sales_summary.Total_Amount.cast("double").alias("Total_Amount")))
register("target_summary")(lambda t, s, d: t.target_summary.drop("Year").withColumn(
    "Total_Target", t.target_summary.Total_Target.cast("double")))
register("load_audit_years")(lambda t, s, d: catalog.rows_per_year(t.sales))
register("load_audit_top_brands")(lambda t, s, d: catalog.top_brands_by_rows(t.sales, 5))
register("load_audit_totals")(lambda t, s, d: catalog.load_totals(t))
register("selector_gm")(lambda t, s, d: catalog.selector(t.sales_summary, "GM", year=P.REPORT_YEAR, non_blank=True))
register("selector_brand")(lambda t, s, d: catalog.selector(t.sales_summary, "Brand", year=P.REPORT_YEAR))
register("selector_salesman")(lambda t, s, d: catalog.selector(t.sales_summary, "Salesman", year=P.REPORT_YEAR))

# ---- sales vs target ----------------------------------------------------------------------------
register("brand_performance")(lambda t, s, d: targets.brand_performance(t, year=P.REPORT_YEAR))
register("gm_performance")(lambda t, s, d: targets.gm_performance(t, year=P.REPORT_YEAR))
register("salesman_performance")(lambda t, s, d: targets.salesman_performance(t, year=P.REPORT_YEAR))
register("salesman_performance_brand")(
    lambda t, s, d: targets.salesman_performance(t, year=P.REPORT_YEAR, brand_filter=P.BRAND))
register("account_performance")(lambda t, s, d: targets.account_performance(t, year=P.REPORT_YEAR))
register("account_performance_brand")(
    lambda t, s, d: targets.account_performance(t, year=P.REPORT_YEAR, brand_filter=P.BRAND))
register("monthly_trend")(lambda t, s, d: targets.monthly_trend(t, year=P.REPORT_YEAR))
register("monthly_trend_brand")(
    lambda t, s, d: targets.monthly_trend(t, year=P.REPORT_YEAR, dimension="Brand", dimension_value=P.BRAND))
register("yoy_comparison")(lambda t, s, d: targets.yoy_comparison(t))
register("yoy_comparison_brand")(lambda t, s, d: targets.yoy_comparison(t, brand=P.BRAND))
register("recommendations")(lambda t, s, d: targets.recommendations(
    targets.brand_performance(t, year=P.REPORT_YEAR, ordered=False), entity_type="Brand", key="Brand"))
register("recommendations_salesman")(lambda t, s, d: targets.recommendations(
    targets.salesman_performance(t, year=P.REPORT_YEAR, ordered=False), entity_type="Salesman", key="Salesman"))
register("recommendations_account")(lambda t, s, d: targets.recommendations(
    targets.account_performance(t, year=P.REPORT_YEAR, ordered=False), entity_type="Account", key="Customer_Name", entities=t.accounts))
register("gap_top10")(lambda t, s, d: targets.gap_top(
    targets.brand_performance(t, year=P.REPORT_YEAR, ordered=False), key="Brand"))

# ---- growth / decline (every brand at once) -----------------------------------------------------
_G = dict(brand=None, year1=P.YEAR1, year2=P.YEAR2)
register("growth_items")(lambda t, s, d: growth.item_growth(t.sales, **_G))
register("growth_customers")(lambda t, s, d: growth.customer_growth(t.sales, **_G))
register("brand_month_pivot")(lambda t, s, d: growth.month_pivot(t.sales, **_G))
register("growth_summary")(lambda t, s, d: growth.growth_summary(t.sales, **_G))
register("growth_classes")(lambda t, s, d: growth.growth_classes(t.sales, **_G))
register("growth_top_customers")(lambda t, s, d: growth.top_customers(t.sales, **_G))
register("brand_overview_items")(lambda t, s, d: growth.year_overview(t.sales, with_lines=False, **_G))
register("growth_categories_overlapping")(lambda t, s, d: growth.growth_flags(t.sales, **_G))
register("growth_customers_top50")(lambda t, s, d: growth.customers_top(t.sales, **_G))
register("brand_months")(lambda t, s, d: growth.brand_months(t.sales, **_G))
register("growth_category_counts")(lambda t, s, d: growth.category_counts(t.sales, **_G))
register("brand_overview")(lambda t, s, d: growth.year_overview(t.sales, **_G))
register("brand_overview_summary")(lambda t, s, d: growth.overview_summary(t.sales, **_G))
register("change_word")(lambda t, s, d: growth.change_words(growth.overview_summary(t.sales, **_G)))
for _part in growth.CONTRIBUTION_SPECS:
    register(f"contrib_{_part}")(
        lambda t, s, d, _p=_part: growth.contribution_by(t.sales, _p, focus="growing", **_G))
register("brand_report_members")(lambda t, s, d: growth.contributions(
    t.sales, tuple(growth.CONTRIBUTION_SPECS), focus="growing", **_G))
register("contrib_brand_mask")(lambda t, s, d: growth.contribution_by(
    t.sales, "item", brand=P.MASK, year1=P.YEAR1, year2=P.YEAR2, focus="declining", use_brand_mask=True))

# ---- coverage -----------------------------------------------------------------------------------
register("coverage_windows")(lambda t, s, d: coverage.coverage_windows(t.sales, as_of=P.AS_OF))
register("coverage_windows_brand")(lambda t, s, d: coverage.coverage_windows(t.sales, as_of=P.AS_OF, level="brand"))
register("coverage_brand_vs_company")(
    lambda t, s, d: coverage.coverage_brand_vs_company(t.sales, as_of=P.AS_OF, brand=None))
register("coverage_loss")(lambda t, s, d: coverage.coverage_loss(t.item_days, as_of=P.AS_OF, entity=None))
register("coverage_comparison")(lambda t, s, d: coverage.coverage_comparison(
    t.sales, as_of=P.AS_OF, brand1=P.BRAND, brand2=P.BRAND2))
register("new_lost_retained")(lambda t, s, d: coverage.new_lost_retained(t.sales, as_of=P.AS_OF, entity=None))

# ---- run-rate and patterns ----------------------------------------------------------------------
register("item_pattern")(lambda t, s, d: patterns.item_pattern(
    t.item_days, as_of=P.AS_OF, months=P.ITEM_MONTHS, items=t.items))
register("item_monthly_data")(
    lambda t, s, d: patterns.item_monthly_data(t.item_days, as_of=P.AS_OF, months=P.ITEM_MONTHS))
register("seasonal_items")(lambda t, s, d: patterns.seasonal_items(t.item_days, as_of=P.AS_OF, months=P.ITEM_MONTHS))
register("anomalies")(lambda t, s, d: patterns.anomalies(t.item_days, as_of=P.AS_OF, months=P.ITEM_MONTHS))
register("run_rate_stability")(lambda t, s, d: patterns.run_rate_stability(
    t.item_days, as_of=P.AS_OF, months=12, entities=t.items))
register("run_rate_months")(lambda t, s, d: patterns.run_rate_months(t.item_days, as_of=P.AS_OF, months=12))
register("overstock_risk")(lambda t, s, d: patterns.overstock_risk(t.sales, as_of=P.AS_OF, days_threshold=90))

# ---- report pages (over the four performance views of the report year) -------------------------
def _bp(t):
    return targets.brand_performance(t, year=P.REPORT_YEAR, ordered=False)


def _gp(t):
    return targets.gm_performance(t, year=P.REPORT_YEAR, ordered=False)


def _sp(t):
    return targets.salesman_performance(t, year=P.REPORT_YEAR, ordered=False)


def _ap(t):
    return targets.account_performance(t, year=P.REPORT_YEAR, ordered=False)


_ACC = ["Salesman", "Emirate", "Channel", "Gap", "Achievement"]
register("brand_kpis")(lambda t, s, d: reports.brand_kpis(_bp(t)))
register("brand_top10_share")(lambda t, s, d: reports.brand_top10_share(_bp(t)))
register("achievement_hist")(lambda t, s, d: reports.achievement_hist(_bp(t)))
register("achievement_hist_salesman")(lambda t, s, d: reports.achievement_hist(_sp(t)))
register("gm_kpis")(lambda t, s, d: reports.gm_kpis(_gp(t)))
register("gm_gauge")(lambda t, s, d: reports.gm_gauge(_gp(t)))
register("salesman_kpis")(lambda t, s, d: reports.salesman_kpis(_sp(t)))
register("salesman_top15")(lambda t, s, d: reports.salesman_top15(_sp(t)))
register("salesman_avg_top10")(lambda t, s, d: reports.salesman_avg_top10(_sp(t)))
register("salesman_categories")(lambda t, s, d: reports.salesman_categories(_sp(t)))
register("account_kpis")(lambda t, s, d: reports.account_kpis(_ap(t)))
register("account_top15")(lambda t, s, d: reports.account_top15(_ap(t)))
register("emirate_distribution")(lambda t, s, d: reports.emirate_distribution(_ap(t)))
register("channel_sales")(lambda t, s, d: reports.channel_sales(_ap(t)))
register("account_size_distribution")(lambda t, s, d: reports.account_size_distribution(_ap(t)))
register("account_health")(lambda t, s, d: reports.account_health(_ap(t)))
register("account_underperforming")(lambda t, s, d: reports.account_underperforming(_ap(t), 10))
register("executive_summary")(lambda t, s, d: reports.executive_summary(_bp(t)))
register("brand_gaps")(lambda t, s, d: reports.ranked_gaps(_bp(t), "Brand", 20, ["Gap", "Achievement", "Customers"]))
register("gm_gaps")(lambda t, s, d: reports.gm_gaps(_gp(t)))
register("salesman_gap_quadrants")(lambda t, s, d: reports.salesman_gap_quadrants(_sp(t)))
register("account_gaps")(lambda t, s, d: reports.ranked_gaps(_ap(t), "Customer_Name", 20, _ACC))
register("emirate_gaps")(lambda t, s, d: reports.emirate_gaps(_ap(t)))
register("priority_accounts")(lambda t, s, d: reports.account_underperforming(_ap(t), 5))
register("salesmen_needing_support")(lambda t, s, d: reports.salesmen_needing_support(_sp(t)))
register("quick_win_brands")(lambda t, s, d: reports.quick_win_brands(_bp(t)))
register("high_value_accounts_below_target")(lambda t, s, d: reports.high_value_accounts_below_target(_ap(t)))
register("critical_counts")(lambda t, s, d: reports.critical_counts(_bp(t), _sp(t)))
register("improvement_zone")(lambda t, s, d: reports.improvement_zone(_bp(t)))
register("best_practice_salesmen")(lambda t, s, d: reports.best_practice_salesmen(_sp(t)))
register("gm_scatter")(lambda t, s, d: reports.gm_scatter(_gp(t)))
register("salesman_scatter")(lambda t, s, d: reports.salesman_scatter(_sp(t)))

# ---- integrated reports -------------------------------------------------------------------------
register("item_health")(lambda t, s, d: integrated.health_columns(integrated.item_health(
    t.days_of(P.AS_OF, integrated.HEALTH_MONTHS), as_of=P.AS_OF, items=t.items)))
register("supply_chain_dashboard")(lambda t, s, d: integrated.supply_chain_dashboard(
    t.days_of(P.AS_OF, integrated.DASHBOARD_MONTHS), as_of=P.AS_OF, items=t.items))
register("dashboard_counts")(lambda t, s, d: integrated.supply_chain_dashboard(
    t.days_of(P.AS_OF, integrated.DASHBOARD_MONTHS), as_of=P.AS_OF, brand=P.BRAND, items=t.items, cards=("oos_items", "supply_issues", "coverage_loss", "seasonal_items")))
for _part in ("oos_items", "supply_issues", "coverage_loss", "seasonal_items", "anomalies"):
    register(f"dashboard_{_part}")(lambda t, s, d, _p=_part: integrated.supply_chain_parts(t.item_days, as_of=P.AS_OF, brand=P.BRAND)[_p])

# ---- order as data: the rank of every row in a report's order --------------------------------------
_desc, _asc = (lambda c: F.col(c).desc_nulls_last()), (lambda c: F.col(c).asc_nulls_first())
register("oos_items_ranked")(lambda t, s, d: global_rank(
    stock.oos_items(t.item_days, as_of=P.AS_OF, days_threshold=P.DAYS, ordered=False).select("Item_Code", "Item_Desc", "Historical_Sales"),
    [_desc("Historical_Sales"), _asc("Item_Code"), _asc("Item_Desc")]))
register("multi_account_oos_ranked")(lambda t, s, d: global_rank(
    stock.multi_account_oos(t.item_days, as_of=P.AS_OF, ordered=False).select("Item_Code", "Stopped_Accounts", "Lost_Sales_Potential"),
    [_desc("Stopped_Accounts"), _desc("Lost_Sales_Potential"), _asc("Item_Code")]))
register("brand_months_ranked")(lambda t, s, d: global_rank(
    growth.brand_months(t.sales, **_G), [_asc("Brand"), _asc("Year"), growth.month_number(F.substring("Month_and_Year", 1, 3)).asc_nulls_first()]))
register("growth_classes_ranked")(lambda t, s, d: global_rank(
    growth.growth_classes(t.sales, **_G).select("Brand", "Item_Desc", "Class", "Growth_Value"),
    [_asc("Brand"), _asc("Class"), F.when(F.col("Class") == growth.CLASS_GROWING, -F.col("Growth_Value")).otherwise(F.col("Growth_Value")).asc_nulls_first(), _asc("Item_Desc")]))
register("account_gaps_all")(lambda t, s, d: reports.ranked_gaps(
    targets.account_performance(t, year=P.REPORT_YEAR, ordered=False).groupBy("Customer_Name").agg(reports.dsum("Gap").alias("Gap")), "Customer_Name", None, ["Gap"]))
register("coverage_windows_item")(lambda t, s, d: coverage.coverage_windows(
    t.item_days, as_of=P.AS_OF, level="item", time_windows=(12, 24, 36)))

# ---- question tagging over templates crossed with every brand and item, and the conversations' user turns ------
_QK = ["qid"]


def _questions(s, d):
    return questions_table(s, d)


def _tag(col: str):
    return lambda t, s, d: questions.tag_rules(_questions(s, d)).select(*_QK, col)


register("q_needs_analysis")(_tag("Needs_Analysis"))
register("q_enhanced_intent")(_tag("Intent"))
register("q_focus")(_tag("Focus"))
register("q_decline_analysis")(_tag("Decline_Analysis"))
register("q_years")(lambda t, s, d: questions.tag_rules(_questions(s, d)).select(*_QK, "Year1", "Year2"))
register("q_days")(_tag("Days"))
register("q_is_classification")(_tag("Is_Classification"))
register("q_overstock_route")(_tag("Overstock_Route"))
register("q_brand")(lambda t, s, d: questions.detect_brand(written(_questions(s, d)), t.brand_names, _QK))
register("q_item")(lambda t, s, d: questions.detect_item(written(_questions(s, d)), t.items, _QK, t.stored_grams))
register("q_auto_context")(lambda t, s, d: questions.auto_context(written(_questions(s, d)), t.brand_names, _QK))
register("q_route")(lambda t, s, d: questions.route(_questions(s, d), t.items, _QK, t.brand_names, t.stored_grams))

# ---- SQL surface and documented questions -------------------------------------------------------
_B = dict(brand=P.BRAND, year1=P.YEAR1, year2=P.YEAR2)
ADHOC_SQL = ("SELECT Channel, COUNT(DISTINCT Customer_Name) AS Customers, CAST(SUM(Amount) AS DOUBLE) AS Sales "
             "FROM sales WHERE Year = :year GROUP BY Channel")
register("non_growing_items")(lambda t, s, d: sqlsurface.non_growing_items(s, t, **_B))
register("growing_items")(lambda t, s, d: sqlsurface.growing_items(s, t, **_B))
register("top_customers")(lambda t, s, d: sqlsurface.top_customers(s, t, year=P.REPORT_YEAR, n=10))
register("sales_vs_target_3key")(lambda t, s, d: sqlsurface.sales_vs_target_3key(t, year=P.REPORT_YEAR))
register("total_sales_by_year")(lambda t, s, d: sqlsurface.total_sales_by_year(s, t))
register("top10_brands")(lambda t, s, d: sqlsurface.top10_brands(s, t))
register("top_bottom_n")(lambda t, s, d: sqlsurface.top_bottom_n(
    t, entity="Salesman", year=P.REPORT_YEAR, n=10, bottom=True))
register("adhoc_sql")(lambda t, s, d: sqlsurface.adhoc_sql(s, t, ADHOC_SQL, {"year": P.REPORT_YEAR}))
register("never_bought_brand")(lambda t, s, d: sqlsurface.never_bought_brand(t.accounts, brand=P.BRAND))
register("items_lost_coverage")(lambda t, s, d: sqlsurface.items_lost_coverage(t.sales, as_of=P.AS_OF))
register("underperforming_channels")(lambda t, s, d: sqlsurface.underperforming_channels(t.sales, **_G))
register("items_not_repeated")(lambda t, s, d: sqlsurface.items_not_repeated(t.sales))
register("customers_seasonal_buyers")(lambda t, s, d: sqlsurface.customers_seasonal_buyers(t.sales))
register("bonus_dependency")(lambda t, s, d: sqlsurface.bonus_dependency(t.sales, year1=P.YEAR1, year2=P.YEAR2))
register("decline_contributors")(lambda t, s, d: sqlsurface.decline_contributors(t.sales, **_G))
