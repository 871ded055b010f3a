"""Plans and partitions that must not gather a growing table in a few tasks."""

import re

from pyspark.sql import functions as F

from salescope.operators import questions
from salescope.sources import fixtures, names
from salescope.sources.questions import questions_table

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_of_a_small_part_file_are_dealt_out(spark):
    asked = questions_table(spark, SF).filter(F.col("qid").startswith("i"))
    sizes = [r["count"] for r in asked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4


def test_tokens_that_every_question_holds_are_spread_or_dropped(spark):
    texts = [(i, f"which is the Brand#{i % 30} of brand number {i}") for i in range(400)]
    asked = spark.createDataFrame(texts, "qid int, question string")
    brands = spark.createDataFrame([(f"Brand#{i}",) for i in (1, 2, 13)] + [("Élan",), ("",), (None,)], "Brand string")
    for find in (questions.detect_brand, questions.auto_context):
        got = {r["qid"]: r["Brand"] for r in find(asked, brands, ["qid"]).collect()}
        if find is questions.detect_brand:
            assert got == {i: f"Brand#{i % 30}" if i % 30 in (1, 2, 13) else None for i, _ in texts}
        else:
            held = {i: [b for b in ("Brand#13", "Brand#1", "Brand#2") if b.lower() in t.lower()] for i, t in texts}
            assert got == {i: hits[0] if hits else None for i, hits in held.items()}
    index = names.brand_names(brands)
    for hits in (questions._whole_word_hits, questions._substring_hits):
        text = executed(hits(asked, ["qid"], index))
        assert re.search(r"Join \[(first|gram)#\d+L?, _salt#", text), text


def test_descriptions_are_found_without_an_index(spark):
    items = spark.createDataFrame([(y, c, d) for y in (1999, 2000) for c, d in (("A-1", "Cold Widget"), ("A-2", "cold widget two"), ("A-3", None), (None, "Warm"))],
                                  "Year int, Item_Code string, Item_Desc string")
    asked = spark.createDataFrame([(0, 'is "Widget T" stable'), (1, 'is "old wid" stable'), (2, '"zzzzz"'), (3, "A-3 or A-2")], "qid int, question string")
    want = {0: "A-2", 1: "A-1", 2: None, 3: "A-3"}
    for grams in (None, names.item_grams(items)):
        assert {r["qid"]: r["Item_Code"] for r in questions.detect_item(asked, items, ["qid"], grams).collect()} == want



def test_lines_are_never_sent_by_nation(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = executed(fixtures.sales_from_star(fixtures.star_base(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\([cs]_nationkey", line):
            assert "l_orderkey" not in lines[at + 1] and "o_orderkey" not in lines[at + 1]
