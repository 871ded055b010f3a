"""A table of business questions derived from the given tables: templates crossed with every brand and every
item, questions without an entity, and the user turns of the conversations.

``qid`` tells where a question comes from: ``b<template>:<brand>``, ``i<template>:<part key>``, ``f<template>`` or
``c<conversation>:<turn>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.sources.fixtures import read_table

# Question texts of the fixture; {} stands for the entity.
BRAND_TEMPLATES = (
    "What is {} brand coverage in the last 12 months?",
    "Compare coverage of {} vs company",
    "Which accounts stopped buying {}?",
    "Which {} items had no sales in the last 45 days?",
    "Show me seasonal items for {}",
    "Supply chain issues for {} brand",
    "Why is {} declining in 1999 vs 2000? 2024 vs 2025",
    "Explain why {} is growing in 2023",
    "What are the non-growing items for {}?",
    "List the {} target achievement",
    "Total sales of {}x and {}",
    "{} out of stock, last 99999999999999999999999 days",
)
ITEM_TEMPLATES = (
    'Is "{code}" demand driven or supply driven? It had no sales for 60 day',
    'Pattern for "{desc}"',
    "Is {code} stable or fluctuating?",
    'Who stopped buying "nothing like it" and "{tail}"?',
)
FREE_TEMPLATES = (
    "What is our coverage?",
    "Compare coverage",
    "Lost accounts",
    "Which items are out of stock in 90days?",
    "Show overstock patterns",
    "Which accounts show a strange risk?",
    "Is it demand driven? not selling",
    "Repeat behavior and reorder spikes",
    "Seasonality of all items",
    "Supply issues and availability",
    "Abbott sales growth in 2024",
    "Why did Bayer drop?",
    "Coverage for bayer",
    "duphaston no sales in 10 days",
    "Total sales by year",
    "",
)


def _filled(template: str, parts: dict[str, Column]) -> Column:
    """The template with its marks replaced by columns."""
    out, rest = [], template
    while rest:
        at = min((i for m in parts if (i := rest.find(m)) >= 0), default=len(rest))
        if at:
            out.append(F.lit(rest[:at]))
        mark = next((m for m in parts if rest.startswith(m, at)), "")
        if mark:
            out.append(parts[mark])
        rest = rest[at + len(mark):]
    return F.concat(*out) if out else F.lit("")


def _listed(kind: str, entity: Column | None, texts: list[Column]) -> Column:
    tail = [F.lit(":"), entity] if entity is not None else []
    return F.explode(F.array(*[F.struct(F.concat(F.lit(f"{kind}{i}"), *tail).alias("qid"), t.alias("question")) for i, t in enumerate(texts)]))


def _pieces(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def questions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question)."""
    # A part gives several questions, and the tagging of a question costs far more than reading its part: a table that
    # lies in a few large pieces would be the work of a few tasks.
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").repartition(_pieces(spark))
    brand, key = F.col("p_brand"), F.col("p_partkey").cast("string")
    desc = F.concat(F.col("p_name"), F.lit(" #"), key)
    item = {"{code}": F.concat(F.lit("ITM-"), key), "{desc}": desc, "{tail}": F.upper(F.expr("right(concat(p_name, ' #', p_partkey), 12)"))}
    frames = [
        part.select("p_brand").distinct().select(_listed("b", brand, [_filled(t, {"{}": brand}) for t in BRAND_TEMPLATES]).alias("q")),
        part.select(_listed("i", key, [_filled(t, item) for t in ITEM_TEMPLATES]).alias("q")),
        spark.range(1).select(_listed("f", None, [F.lit(t) for t in FREE_TEMPLATES]).alias("q")),
        read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
            F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("question")).alias("q")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("q.qid", "q.question")
