"""One question to its answer: the question is tagged and routed as a one-row table, and the operator named by
its route runs over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators import coverage, growth, integrated, patterns, questions, stock
from salescope.sources.tables import Tables


def answer(question: str, t: Tables, *, as_of) -> dict:
    """``route`` (one row as a dict), ``data`` and, where the route has a second list, ``also``.

    ``data`` is None where the question needs an entity or is left to SQL; a number of days that no calendar holds is
    an error. ``parts`` has the lists behind a report by name: the eight parts of a brand's two years, the five lists of
    its supply chain; no entry elsewhere.
    """
    spark = t.sales.sparkSession
    r = questions.route(spark.createDataFrame([(0, question)], "qid int, question string"), t.items, ["qid"], t.brand_names, t.stored_grams).first().asDict()
    data, also = run_route(r, t, as_of=as_of)
    return {"route": r, "data": data, "also": also, "parts": report_parts(r, t, as_of=as_of)}


def report_parts(r: dict, t: Tables, *, as_of) -> dict[str, DataFrame]:
    """The lists of the reports that have several."""
    brand, mask = r["Route_Brand"], r["Route_Mask"]
    if r["Route"] == "brand_analysis":
        return growth.brand_report(t.sales, brand=mask or brand, year1=r["Year1"], year2=r["Year2"], focus=r["Focus"], use_brand_mask=bool(mask))
    if r["Route"] == "supply_chain_dashboard":
        if mask:
            return integrated.supply_chain_parts(masked(t.sales, mask).withColumn("Brand", F.lit(mask)), as_of=as_of, brand=mask)
        return integrated.supply_chain_parts(t.item_days, as_of=as_of, brand=brand)
    return {}


def masked(sales: DataFrame, mask: str | None) -> DataFrame:
    """Sales of a brand family, found by its mask."""
    return sales if not mask else sales.filter(F.lower("Brand_Mask").contains(mask.lower()))


def run_route(r: dict, t: Tables, *, as_of) -> tuple[DataFrame | None, DataFrame | None]:
    name, brand, item, days, months = r["Route"], r["Route_Brand"], r["Route_Item"], r["Route_Days"], r["Route_Months"]
    if days is not None and days < 0:
        raise ValueError("the number of days cannot be read")
    sales = masked(t.sales, r["Route_Mask"])
    one = None if r["Route_Mask"] else brand  # a family is already filtered
    if name == "coverage_windows:company":
        return coverage.coverage_windows(t.sales, as_of=as_of), None
    if name == "coverage_windows:brand":
        return coverage.coverage_windows(sales, as_of=as_of, level="brand" if one else "company", entity=one), None
    if name == "coverage_brand_vs_company":
        if one:
            return coverage.coverage_brand_vs_company(t.sales, as_of=as_of, brand=one), None
        own = coverage.coverage_windows(sales, as_of=as_of).withColumn("Type", F.lit(f"Brand ({r['Route_Mask']})"))
        return own.unionByName(coverage.coverage_windows(t.sales, as_of=as_of).withColumn("Type", F.lit("Company"))), None
    if name == "coverage_loss:item":
        return coverage.coverage_loss(t.sales, as_of=as_of, entity=item, entity_type="Item_Code"), None
    if name == "coverage_loss:brand+new_lost_retained":
        if not one:  # the family's members, whatever its brands
            sales, one = sales.withColumn("Brand", F.lit(r["Route_Mask"])), r["Route_Mask"]
        return coverage.coverage_loss(sales, as_of=as_of, entity=one), coverage.new_lost_retained(sales, as_of=as_of, entity=one)
    if name == "decline_cause":
        return stock.decline_cause(t.sales, as_of=as_of, item_code=item), None
    if name == "oos_items:brand+multi_account_oos":
        return (stock.oos_items(sales, as_of=as_of, brand=one, days_threshold=days),
                stock.multi_account_oos(sales, as_of=as_of, brand=one, days_threshold=days))
    if name == "oos_items:all":
        return stock.oos_items(t.sales, as_of=as_of, days_threshold=days), None
    if name == "overstock_risk":
        return patterns.overstock_risk(t.sales, as_of=as_of), None
    if name == "seasonal_items:brand+anomalies":
        return patterns.seasonal_items(sales, as_of=as_of, brand=one, months=months), patterns.anomalies(sales, as_of=as_of, brand=one)
    if name == "seasonal_items:all":
        return patterns.seasonal_items(t.sales, as_of=as_of, months=months), None
    if name == "item_pattern":
        return patterns.item_pattern(t.sales, as_of=as_of, months=months, item_code=item), None
    if name == "supply_chain_dashboard":
        if not one:
            sales, one = sales.withColumn("Brand", F.lit(r["Route_Mask"])), r["Route_Mask"]
        return integrated.supply_chain_dashboard(sales, as_of=as_of, brand=one), None
    if name == "brand_analysis":
        if one:
            return growth.overview_summary(t.sales, brand=one, year1=r["Year1"], year2=r["Year2"]), growth.contribution_by(
                t.sales, "item", brand=one, year1=r["Year1"], year2=r["Year2"], focus=r["Focus"])
        return growth.overview_summary(t.sales, brand=r["Route_Mask"], year1=r["Year1"], year2=r["Year2"], use_brand_mask=True), growth.contribution_by(
            t.sales, "item", brand=r["Route_Mask"], year1=r["Year1"], year2=r["Year2"], focus=r["Focus"], use_brand_mask=True)
    return None, None  # needs_brand, needs_entity, sql
