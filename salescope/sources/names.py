"""Indexes of names, kept beside the dimensions: how brands begin, and which character runs item texts hold.

``brand_names``: a name's lower-case form, its first token and number of tokens (a token is a run of word characters
or one other character), for whole-word search from token starts; and of its runs of ``GRAM`` characters the one that
the fewest names hold, for substring search. ``item_grams``: a posting for each run of ``ITEM_GRAM`` characters of each
item's description. Both are made by year, like the dimensions; entries of several years merge by distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.text import WORD_CHAR

GRAM = 3
ITEM_GRAM = 5
TOKEN = rf"({WORD_CHAR}+|[^{WORD_CHAR[1:-1]}])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` characters, none where the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, size))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _year(rows: DataFrame) -> list[str]:
    return ["Year"] if "Year" in rows.columns else []


def brand_names(rows: DataFrame) -> DataFrame:
    """(Year,) Brand, name, first, n_tokens, gram; ``rows`` is anything with a Brand."""
    by = _year(rows)
    names = rows.select(*by, "Brand").filter(F.col("Brand").isNotNull() & (F.col("Brand") != "")).distinct()
    names = names.withColumn("name", F.lower("Brand"))
    size = F.least(F.length("name"), F.lit(GRAM))
    each = names.select(*by, "Brand", "name", F.explode(grams(F.col("name"), size)).alias("_g"))
    each = each.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_g")))  # a run's names: names are few
    rare = each.groupBy(*by, "Brand", "name").agg(F.min(F.struct("_n", "_g"))["_g"].alias("gram"))
    words = tokens(F.col("name"))
    return rare.select(*by, "Brand", "name", words[0].alias("first"), F.size(words).alias("n_tokens"), "gram")


def item_grams(rows: DataFrame) -> DataFrame:
    """(Year,) gram, Item_Code, text: the lower-case description under each of its runs of characters."""
    by = _year(rows)
    items = rows.filter(F.col("Item_Code").isNotNull() & F.col("Item_Desc").isNotNull())
    items = items.select(*by, "Item_Code", F.lower("Item_Desc").alias("text")).distinct()
    return items.select(*by, F.explode(grams(F.col("text"), ITEM_GRAM)).alias("gram"), "Item_Code", "text")
