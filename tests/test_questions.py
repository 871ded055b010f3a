"""Question tagging: the reference's table-driven cases as assertions, plus brute-force checks of the
dictionary lookups on a hand-made fixture (Python's ``re`` gives the expected answers)."""

import re

import pytest
from pyspark.sql import functions as F

from salescope.operators import questions as N

# Questions with the tag they must get.
FOCUS_CASES = [
    ("give me the reason why OBG is Growing in 2025 vs 2024", "growing"),
    ("Why is DUP declining in 2025?", "declining"),
    ("What are the non-growing items for DUP?", "declining"),
    ("Show me growing items for OBG", "growing"),
    ("Which items are increasing for DUP?", "growing"),
    ("What's causing the drop in sales?", "declining"),
    ("Why is OBG brand growth improving?", "growing"),
    ("Explain the decline for DUP", "declining"),
    ("Show me items with positive growth", "growing"),
    ("Which products are underperforming?", "declining"),
    ("Compare OBG 2024 vs 2025", "all"),
]

# Questions with the tag they must get.
INTENT_CASES = [
    ("What is DUP brand coverage in the last 12 months?", "coverage"),
    ("Which accounts stopped buying DUP?", "coverage_loss"),
    ("Which DUP items had no sales in the last 30 days?", "oos"),
    ("Show me seasonal items for DUP", "pattern"),
    ("Supply chain issues for DUP brand", "supply_chain"),
    ("What are the non-growing items for DUP?", None),
    # Literal substring rules: 'risk' is a coverage-loss keyword checked before the pattern rules.
    ("Which accounts risk overstock?", "coverage_loss"),
]

BRANDS = ["Brand#1", "Brand#13", "DUP", "OBG", "Pfizer", "Pfizer Plus", "Élan"]
ITEMS = [("NPB-168-0", "Panadol Extra 500mg"), ("10-200-45", "Brufen 400"), ("ITM-7", "Cold Widget #7"),
         ("ITM-8", "Cold Widget #8")]


@pytest.fixture(scope="module")
def fixture_sales(spark):
    rows = []
    for i, b in enumerate(BRANDS):
        code, desc = ITEMS[i % len(ITEMS)]
        rows.append((b, code, desc))
    for code, desc in ITEMS:
        rows.append(("OBG", code, desc))
    return spark.createDataFrame(rows, "Brand string, Item_Code string, Item_Desc string")


def qdf(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, question string")


def by_qid(df, col):
    return {r["qid"]: r[col] for r in df.collect()}


def test_focus_cases(spark):
    df = N.tag_rules(qdf(spark, [q for q, _ in FOCUS_CASES]))
    got = by_qid(df, "Focus")
    assert [got[i] for i in range(len(FOCUS_CASES))] == [e for _, e in FOCUS_CASES]


def test_intent_cases(spark):
    df = N.tag_rules(qdf(spark, [q for q, _ in INTENT_CASES]))
    got = by_qid(df, "Intent")
    assert [got[i] for i in range(len(INTENT_CASES))] == [e for _, e in INTENT_CASES]


def test_substring_keywords_are_literal(spark):
    # 'up' is a growth keyword and a substring of 'group' and 'supply' (kept as the specification).
    df = N.tag_rules(qdf(spark, ["sales by account group", "supply status"]))
    assert set(by_qid(df, "Focus").values()) == {"growing"}


def test_years_and_days(spark):
    texts = ["2024 vs 2025", "sales in 2023", "no year", "2025 then 2021 and 2025", "last 60 days", "90day view",
             "99999999999999999999999 days", "in 45\u00a0days"]
    df = N.tag_rules(qdf(spark, texts))
    y = {r["qid"]: (r["Year1"], r["Year2"], r["Days"]) for r in df.collect()}
    assert y[0][:2] == (2024, 2025) and y[1][:2] == (2022, 2023) and y[2][:2] == (2024, 2025)
    assert y[3][:2] == (2021, 2025)
    assert (y[4][2], y[5][2], y[0][2], y[6][2]) == (60, 90, 30, N.UNREADABLE_DAYS) and y[7][2] == 45


def _brute_brand(q):
    ql = q.lower()
    for alias, target in N.BRAND_ALIASES:
        if alias in ql:
            return target
    for b in sorted(BRANDS, key=lambda b: (-len(b), b)):
        if re.search(r"\b" + re.escape(b.lower()) + r"\b", ql):
            return b
    return None


BRAND_QUESTIONS = [
    "Why is DUP declining?", "abbott sales", "Bayer coverage", "brand#13 growth", "brand#1 growth",
    "pfizer plus items", "dupes are not dup", "no brand here", "OBG's growth", "élan vital", "xélan",
    "brand#1x and brand#1", "compare Brand#13 with Brand#1", "", "DUP_X is not a brand", "(dup)",
]


def test_brand_detection_matches_brute_force(spark, fixture_sales):
    df = N.detect_brand(qdf(spark, BRAND_QUESTIONS), fixture_sales, ["qid"])
    got = by_qid(df, "Brand")
    assert [got[i] for i in range(len(BRAND_QUESTIONS))] == [_brute_brand(q) for q in BRAND_QUESTIONS]


def _brute_item(q):
    codes = sorted(ITEMS)
    for quoted in re.findall(r'"([^"]*)"', q):
        hit = [c for c, d in codes if c == quoted or d == quoted]
        if hit:
            return hit[0]
        if len(quoted) > 4:
            hit = [c for c, d in codes if quoted.lower() in d.lower()]
            if hit:
                return hit[0]
    for code in re.findall(r"\b[A-Za-z0-9]+-[A-Za-z0-9-]+\b", q):
        if code in dict(ITEMS):
            return code
    return None


ITEM_QUESTIONS = [
    'Is "NPB-168-0" stable?', 'Pattern for "Brufen 400"', 'Pattern for "panadol"', 'Pattern for "pan"',
    "What about 10-200-45 and NPB-168-0?", "Check ITM-7 now", "Check itm-7", '"unknown thing" and NPB-168-0',
    'Trend of "cold widget"', "ITM-7-", "éITM-7", "x_ITM-8 and ITM-8", "",
]


def test_item_detection_matches_brute_force(spark, fixture_sales):
    df = N.detect_item(qdf(spark, ITEM_QUESTIONS), fixture_sales, ["qid"])
    got = by_qid(df, "Item_Code")
    assert [got[i] for i in range(len(ITEM_QUESTIONS))] == [_brute_item(q) for q in ITEM_QUESTIONS]


def test_dashed_code_pattern_matches_python_word_boundaries(spark):
    texts = ["AB-CD-", "éAB-1 x", "x_AB-1", "AB-1é", "(AB-1)", "AB--", "a-b-c d-e", "-AB-1-", "1-2 3-4"]
    df = qdf(spark, texts).select("qid", F.regexp_extract_all("question", F.lit(N.CODE_PATTERN), F.lit(0)).alias("m"))
    got = by_qid(df, "m")
    assert [list(got[i]) for i in range(len(texts))] == [
        re.findall(r"\b[A-Za-z0-9]+-[A-Za-z0-9-]+\b", t) for t in texts]


ROUTE_CASES = [
    ("Which accounts stopped buying Brand#1?", "coverage_loss:brand+new_lost_retained"),
    ("Which accounts risk overstock?", "needs_entity"),
    ("Show overstock patterns", "overstock_risk"),
    ('Is "NPB-168-0" demand driven or supply driven? no sales', "decline_cause"),
    ("seasonal items", "seasonal_items:all"),
    ("seasonal items for OBG", "seasonal_items:brand+anomalies"),
    ("Is ITM-7 stable or fluctuating?", "item_pattern"),
    ("Supply chain issues", "needs_brand"),
    ("Compare coverage for DUP", "coverage_brand_vs_company"),
    ("What is our coverage?", "coverage_windows:company"),
    ("no sales for DUP in 60 days", "oos_items:brand+multi_account_oos"),
    ("total sales by year", "sql"),
    ("Why is DUP declining?", "brand_analysis"),
    ("Coverage for bayer", "coverage_windows:brand"),
]


def test_routes(spark, fixture_sales):
    df = N.route(qdf(spark, [q for q, _ in ROUTE_CASES]), fixture_sales, ["qid"])
    got = by_qid(df, "Route")
    assert [got[i] for i in range(len(ROUTE_CASES))] == [r for _, r in ROUTE_CASES]
    days = by_qid(df, "Route_Days")
    assert days[10] == 60


def test_every_route_and_rule_is_met_by_the_questions_table(spark, tables):
    from salescope.sources.questions import questions_table

    asked = questions_table(spark, "/root/testdata/sf0.001")
    routes = {r.Route for r in N.route(asked, tables.sales, ["qid"]).select("Route").distinct().collect()}
    assert routes == {"sql", "brand_analysis", "coverage_windows:brand", "coverage_windows:company", "coverage_loss:item", "coverage_loss:brand+new_lost_retained",
                      "needs_entity", "coverage_brand_vs_company", "needs_brand", "decline_cause", "oos_items:brand+multi_account_oos", "oos_items:all",
                      "overstock_risk", "seasonal_items:brand+anomalies", "item_pattern", "seasonal_items:all", "supply_chain_dashboard"}
    tags = N.tag_rules(asked)
    for col, values in (("Intent", 7), ("Focus", 3), ("Decline_Analysis", 2), ("Is_Classification", 2), ("Overstock_Route", 2), ("Needs_Analysis", 2)):
        assert tags.select(col).distinct().count() >= values, col
    assert {10, 30, 45, 60, 90, N.UNREADABLE_DAYS} <= {r.Days for r in tags.select("Days").distinct().collect()}


def test_dispatcher_answers(spark, tables):
    import datetime as dt

    from salescope.operators import coverage, stock
    from salescope.operators.dispatch import answer

    as_of = dt.date(2001, 8, 1)
    got = answer("Which Brand#1 items had no sales in the last 45 days?", tables, as_of=as_of)
    assert got["route"]["Route"] == "oos_items:brand+multi_account_oos" and got["also"] is not None
    assert got["data"].collect() == stock.oos_items(tables.sales, as_of=as_of, brand="Brand#1", days_threshold=45).collect()
    got = answer("Coverage for bayer", tables, as_of=as_of)
    assert got["route"]["Route_Mask"] == "Bayer" and [r.Coverage_Count for r in got["data"].collect()] == [0, 0, 0, 0]
    got = answer("Why is Brand#1 declining in 1999 vs 2000?", tables, as_of=as_of)
    assert got["route"]["Route"] == "brand_analysis" and got["data"].count() == 1 and got["also"].count() > 0
    got = answer("What is our coverage?", tables, as_of=as_of)
    assert got["data"].collect() == coverage.coverage_windows(tables.sales, as_of=as_of).collect()
    assert answer("Total sales by year", tables, as_of=as_of)["data"] is None
    with pytest.raises(ValueError):
        answer("oos for 99999999999999999999999 days", tables, as_of=as_of)


def test_auto_context(spark, fixture_sales):
    texts = ["Why is obg down in 2024?", "duphaston top sellers", "pfizer plus vs pfizer", "nothing"]
    df = N.auto_context(qdf(spark, texts), fixture_sales, ["qid"])
    r = {x["qid"]: (x["Brand"], x["Years"], x["Analysis_Type"]) for x in df.collect()}
    assert r[0] == ("OBG", "2024", "declining")
    assert r[1] == ("DUP", "2024,2025", "growing")  # 'duphaston' contains 'up' (literal substring rule)
    assert r[2] == ("Pfizer Plus", "2024,2025", "comparison")
    assert r[3] == (None, "2024,2025", "general")


def test_no_python_udf_in_tagging(spark, fixture_sales):
    plan = N.route(qdf(spark, ["x"]), fixture_sales, ["qid"])._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan
