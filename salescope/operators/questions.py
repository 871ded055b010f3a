"""Question tagging (N1-N12) as one Spark job over a questions table ``(qid..., question)``.

Each tag is a column expression over the lower-cased question, except the two dictionary lookups (brand N3/N10,
item N4), which are equi-joins between parts of the questions and indexes of names (``sources/names.py``): tokens that a
name begins with, or a name's rarest run of characters. A question gives rows in proportion to its length, and no
question x dictionary product is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.text import any_keyword, first_label, is_word_char
from salescope.session import written
from salescope.sources import names

Q = "question"

# Keyword lists of the reference's question rules, in their listed order.
ANALYSIS_KEYWORDS = [
    "why", "reason", "cause", "explain", "investigate", "analysis",
    "growth", "decline", "drop", "increase", "decrease", "change",
    "compare", "comparison", "vs", "versus", "trend", "pattern",
    "non growing", "non-growing", "not growing", "declining",
    "underperforming", "problem", "issue", "concern",
    "coverage", "reach", "penetration", "accounts bought",
    "stopped buying", "lost accounts", "inactive", "churn",
    "out of stock", "oos", "no sales", "stopped selling",
    "seasonal", "seasonality", "stable", "fluctuating", "pattern",
]
INTENT_RULES = [
    ("comparison", ["compare coverage", "coverage vs", "coverage comparison", "brand vs company", "company vs brand"]),
    ("coverage_loss", ["stopped buying", "lost accounts", "inactive", "not buying", "churn", "not recently",
                       "dropped", "lost", "risk"]),
    ("oos", ["out of stock", "oos", "no sales", "stopped selling", "zero sales", "not selling", "supply vs demand",
             "demand vs supply", "demand-driven", "supply-driven"]),
    ("pattern", ["seasonal", "seasonality", "pattern", "stable", "fluctuating", "behavior", "repeat", "reorder",
                 "strange", "spike"]),
    ("supply_chain", ["supply chain", "supply issues", "availability"]),
    ("coverage", ["coverage", "reach", "penetration", "accounts bought", "how many accounts", "listing"]),
]
DECLINE_KEYWORDS = ["declining", "decline", "decrease", "decreasing", "drop", "dropping",
                    "fall", "falling", "loss", "losing", "down", "negative", "non-growing",
                    "non growing", "not growing", "underperforming", "slowing"]
GROWTH_KEYWORDS = ["growing", "growth", "increase", "increasing", "rise", "rising",
                   "improve", "improving", "gain", "gaining", "up", "positive"]
GROWTH_NEGATIONS = ["not growing", "non-growing", "non growing"]
DECLINE_TRIGGERS = [
    "why", "reason", "cause", "explain", "investigate",
    "declining", "decline", "drop", "dropping", "decrease", "decreasing",
    "growing", "growth", "increase", "increasing",
    "change", "changed", "difference",
    "compare", "comparison", "vs", "versus",
    "what happened", "what is happening",
    "analyze", "analysis", "breakdown",
    "contributing", "contribution",
    "performance", "performing",
]
CLASSIFICATION_KEYWORDS = ["demand driven", "supply driven", "demand or supply"]
OVERSTOCK_KEYWORDS = ["overstock", "risk"]
BRAND_ALIASES = [("abbott", "DUP"), ("duphalac", "DUP"), ("duphaston", "DUP"), ("bayer", "BAYER_MASK")]
AUTO_ALIASES = [("abbott", "DUP"), ("duphalac", "DUP"), ("duphaston", "DUP")]
AUTO_YEARS = [2022, 2023, 2024, 2025]
AUTO_DEFAULT_YEARS = (2024, 2025)
AUTO_TYPE_RULES = [
    ("declining", ["non-growing", "non growing", "declining", "decrease", "drop", "fall", "down"]),
    ("growing", ["growing", "increase", "growth", "up", "rise"]),
    ("comparison", ["compare", "comparison", "vs", "versus"]),
    ("root_cause", ["why", "reason", "cause", "explain"]),
    ("top_performers", ["top", "best", "highest"]),
    ("bottom_performers", ["bottom", "worst", "lowest"]),
    ("achievement", ["target", "achievement", "performance"]),
]
DEFAULT_YEARS = (2024, 2025)
DEFAULT_DAYS = 30
# Years and day counts in a question. The (?U) flag gives \s and \d their Unicode meaning.
YEAR_PATTERN = r"20\d{2}"
DAYS_PATTERN = r"(?U)(\d+)\s*days?"
UNREADABLE_DAYS = -1  # a day count beyond 64 bits
QUOTED_PATTERN = r'"([^"]*)"'
CODE_PATTERN = (r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
                r"[A-Za-z0-9]+-[A-Za-z0-9-]+"
                r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))")
SUBSTRING_MIN_LEN = 5  # quoted text longer than 4 characters is also tried as a description substring


def lower_q() -> Column:
    return F.lower(F.col(Q))


def questions_from_conversations(conversations: DataFrame) -> DataFrame:
    """User turns of the conversations table as the questions to tag."""
    return conversations.filter(F.col("role") == F.lit("user")).select("conv_id", "turn", F.col("text").alias(Q))


# ---- per-row rules ------------------------------------------------------------------------------

def needs_analysis() -> Column:
    """N1."""
    return any_keyword(lower_q(), ANALYSIS_KEYWORDS)


def enhanced_intent() -> Column:
    """First matching intent, or NULL."""
    return first_label(lower_q(), INTENT_RULES)


def focus() -> Column:
    """Declining / growing / all (decline keywords first; growth unless negated)."""
    ql = lower_q()
    growing = any_keyword(ql, GROWTH_KEYWORDS) & ~any_keyword(ql, GROWTH_NEGATIONS)
    return F.when(any_keyword(ql, DECLINE_KEYWORDS), F.lit("declining")).when(growing, F.lit("growing")) \
        .otherwise(F.lit("all"))


def decline_analysis() -> Column:
    """N6."""
    return any_keyword(lower_q(), DECLINE_TRIGGERS)


def years() -> tuple[Column, Column]:
    """>= 2 distinct years -> the two smallest; 1 -> (y-1, y); none -> (2024, 2025)."""
    ys = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.col(Q), F.lit(YEAR_PATTERN), F.lit(0)),
                                                   lambda s: s.cast("int"))))
    n = F.size(ys)
    y1 = F.when(n >= 2, ys[0]).when(n == 1, ys[0] - 1).otherwise(F.lit(DEFAULT_YEARS[0]))
    y2 = F.when(n >= 2, ys[1]).when(n == 1, ys[0]).otherwise(F.lit(DEFAULT_YEARS[1]))
    return y1.cast("int"), y2.cast("int")


def days() -> Column:
    """First 'N day(s)' in the question, default 30; ``UNREADABLE_DAYS`` where the number is no BIGINT."""
    raw = F.regexp_extract(lower_q(), DAYS_PATTERN, 1)
    return F.when(raw == "", F.lit(DEFAULT_DAYS).cast("bigint")).otherwise(
        F.coalesce(raw.try_cast("bigint"), F.lit(UNREADABLE_DAYS).cast("bigint")))


def is_classification() -> Column:
    """N9."""
    return any_keyword(lower_q(), CLASSIFICATION_KEYWORDS)


def tag_rules(questions: DataFrame) -> DataFrame:
    """N1, N2, N5-N9 and N12 in one projection."""
    y1, y2 = years()
    intent = enhanced_intent()
    return questions.select(
        *[c for c in questions.columns if c != Q],
        needs_analysis().alias("Needs_Analysis"),
        intent.alias("Intent"),
        focus().alias("Focus"),
        decline_analysis().alias("Decline_Analysis"),
        y1.alias("Year1"), y2.alias("Year2"),
        days().alias("Days"),
        is_classification().alias("Is_Classification"),
        ((intent == "pattern") & any_keyword(lower_q(), OVERSTOCK_KEYWORDS)).alias("Overstock_Route"),
    )


# ---- dictionary lookups -------------------------------------------------------------------------

def _names(brands: DataFrame) -> DataFrame:
    """The index of brand names, made here where ``brands`` is a table with brands only. It is written once: each of the
    joins with it would otherwise make it anew from what the brands are read from."""
    index = brands if "gram" in brands.columns else names.brand_names(brands)
    return written(index.select("Brand", "name", "first", "n_tokens", "gram").distinct())


def _alias_expr(aliases: list[tuple[str, str]]) -> Column:
    expr = F.lit(None).cast("string")
    for alias, target in reversed(aliases):
        expr = F.when(lower_q().contains(alias), F.lit(target)).otherwise(expr)
    return expr


SLOTS = 1024  # of a table of hashes: parts of a question whose hash no name shares go before any shuffle
SALTS = 32  # a part of questions that many share is joined in that many pieces


def _slot(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(SLOTS)).cast("int")


def _taken(part: str) -> Column:
    """For each slot whether a name's ``part`` falls into it: an array of fixed size, whatever the number of names."""
    slots = F.collect_set(_slot(F.col(part)))
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_contains(slots, i))


def _may_match(taken: Column, part: Column) -> Column:
    return F.element_at(taken, _slot(part) + 1)


def _salt(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int").alias("_salt")


def _salted(names_: DataFrame) -> DataFrame:
    """Every row once for each salt: names are few, questions that share a token are not."""
    return names_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _whole_word_hits(questions: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """(keys, Brand, _len) for every name that stands in the lower-cased question as whole words.

    One row for each token of a question that may begin a name, with the few tokens that a name may take. Those that no name
    begins with go first, most of them before any shuffle; the others give one candidate for each number of tokens that a
    name with this first one has. A token that all questions hold is spread by salt. A name that begins or ends with another
    character than a word character has a boundary there only beside a word character.
    """
    known = index.agg(F.max("n_tokens").alias("_most"), _taken("first").alias("_taken"))  # one row
    starts = index.groupBy("first").agg(F.collect_set("n_tokens").alias("_sizes"))
    words = questions.select(*keys, names.tokens(lower_q()).alias("_t")).crossJoin(F.broadcast(known))
    t, i = F.col("_t"), F.col("_i")
    begins = F.filter(F.transform(t, lambda token, i: F.struct(token.alias("first"), i.alias("_i"))), lambda e: _may_match(F.col("_taken"), e["first"]))
    each = words.withColumn("_e", F.explode(begins)).select(*keys, "_t", "_most", "_e.*")
    before = F.when(i > 0, F.try_element_at(t, i)).otherwise(F.lit(""))
    each = each.select(*keys, "first", F.slice(t, i + 1, F.col("_most") + 1).alias("w"), is_word_char(F.right(before, F.lit(1))).alias("after_word"), _salt(*keys, "_i"))
    on = ["first", "_salt"]
    spans = each.join(_salted(starts), on).select(*keys, "w", "after_word", "_salt", F.explode("_sizes").alias("_n")).filter(F.col("_n") <= F.size("w"))
    after = F.coalesce(F.try_element_at("w", F.col("_n") + 1), F.lit(""))
    spans = spans.select(*keys, F.array_join(F.slice("w", F.lit(1), F.col("_n")), "").alias("name"), "after_word",
                         is_word_char(F.left(after, F.lit(1))).alias("before_word"), "_salt")
    hits = spans.join(_salted(index), ["name", "_salt"])
    edges = (F.col("after_word") != is_word_char(F.left("name", F.lit(1)))) & (F.col("before_word") != is_word_char(F.right("name", F.lit(1))))
    return hits.filter(edges).select(*keys, "Brand", F.length("name").alias("_len")).distinct()


def _substring_hits(questions: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """(keys, Brand, _len) for every name contained in the lower-cased question.

    Names are found by their rarest run of characters, so a question gives as many rows as it has runs that a name may be
    found by; whether the name is contained is then tested on those alone. A run that all questions hold is spread by salt.
    """
    known = index.agg(F.collect_set(F.length("gram")).alias("_sizes"), _taken("gram").alias("_taken"))  # one row, at most GRAM sizes
    asked = questions.select(*keys, lower_q().alias("_ql"))
    runs = F.filter(F.flatten(F.transform("_sizes", lambda n: names.grams(F.col("_ql"), n))), lambda g: _may_match(F.col("_taken"), g))
    found = asked.crossJoin(F.broadcast(known)).select(*keys, F.explode(runs).alias("gram"), _salt(*keys)).join(_salted(index), ["gram", "_salt"])
    found = found.select(*keys, "Brand", "name").distinct().join(asked, keys)
    return found.filter(F.col("_ql").contains(F.col("name"))).select(*keys, "Brand", F.length("name").alias("_len")).distinct()


def _longest(hits: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Longest entry per question, ties by name (the reference's order among equal lengths is arbitrary)."""
    best = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("_len")).alias("l"), F.col("Brand").alias("b"))).alias("_m"))
    return best.select(*keys, F.col("_m.b").alias(out))


def detect_brand(questions: DataFrame, brands: DataFrame, keys: list[str]) -> DataFrame:
    """Alias first (listed order), else the longest brand matched as a whole word.

    ``brands`` is the index of names, or any table with brands."""
    hits = _whole_word_hits(questions, keys, _names(brands))
    found = _longest(hits, keys, "_dict")
    return (questions.select(*keys, _alias_expr(BRAND_ALIASES).alias("_alias"))
            .join(found, keys, "left")
            .select(*keys, F.coalesce("_alias", "_dict").alias("Brand")))


def auto_context(questions: DataFrame, brands: DataFrame, keys: list[str]) -> DataFrame:
    """Brand (alias, else a brand contained anywhere), years from a fixed list, analysis type."""
    hits = _substring_hits(questions, keys, _names(brands))
    found = _longest(hits, keys, "_dict")
    ql = lower_q()
    yrs = F.filter(F.array(*[F.when(ql.contains(str(y)), F.lit(y)) for y in AUTO_YEARS]), lambda y: y.isNotNull())
    yrs = F.when(F.size(yrs) == 0, F.array(*[F.lit(y) for y in AUTO_DEFAULT_YEARS])).otherwise(yrs)
    base = questions.select(*keys, _alias_expr(AUTO_ALIASES).alias("_alias"),
                            F.array_join(yrs, ",").alias("Years"),
                            first_label(ql, AUTO_TYPE_RULES, "general").alias("Analysis_Type"))
    return base.join(found, keys, "left").select(
        *keys, F.coalesce("_alias", "_dict").alias("Brand"), "Years", "Analysis_Type")


def detect_item(questions: DataFrame, items: DataFrame, keys: list[str], grams: DataFrame | None = None) -> DataFrame:
    """Quoted text as exact code/description, then (if longer than 4) as a description
    substring, then dashed codes in the question; first hit in that order; the smallest matching
    Item_Code stands in for the reference's unordered ``LIMIT 1``.

    ``items`` is the dimension, or any table with items; ``grams`` its index of character runs (made here without it, from
    the items of all years at once). The items, the quoted texts and codes are written once. A quoted text without an exact match is looked up under its rarest
    run of characters, so that the words all descriptions share bring no pairs; containment is then verified.
    """
    quoted = F.regexp_extract_all(F.col(Q), F.lit(QUOTED_PATTERN), F.lit(1))
    dashed = F.regexp_extract_all(F.col(Q), F.lit(CODE_PATTERN), F.lit(0))
    named = lambda src: lambda q, i: F.struct(F.lit(src).alias("_src"), i.alias("_pos"), q.alias("_q"))
    parts = questions.select(*keys, F.explode(F.concat(F.transform(quoted, named(0)), F.transform(dashed, named(1)))).alias("_p"))
    parts = written(parts.select(*keys, "_p.*"))
    items = written(items.filter(F.col("Item_Code").isNotNull()).select("Item_Code", "Item_Desc").distinct())
    known = items.select("Item_Code", F.explode(F.array(
        F.struct(F.col("Item_Code").alias("_q"), F.lit(False).alias("_desc")), F.struct(F.col("Item_Desc").alias("_q"), F.lit(True).alias("_desc")))).alias("_n"))
    known = known.select("Item_Code", "_n.*").distinct()
    exact = parts.join(known, "_q").filter(~F.col("_desc") | (F.col("_src") == 0)).select(*keys, "_src", "_pos", F.lit(0).alias("_kind"), "Item_Code")

    open_q = parts.filter((F.col("_src") == 0) & (F.length("_q") >= SUBSTRING_MIN_LEN)).join(
        exact.filter(F.col("_src") == 0).select(*keys, "_pos").distinct(), [*keys, "_pos"], "left_anti").withColumn("_ql", F.lower("_q"))
    postings = names.item_grams(items) if grams is None else grams
    seeds = open_q.select("_ql").distinct().select("_ql", F.explode(names.grams(F.col("_ql"), names.ITEM_GRAM)).alias("gram"))
    # Counted before any join: a run that all items hold is then summed where it is read.
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = seeds.join(counts, "gram", "left").groupBy("_ql").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_m"))
    contained = (rarest.filter("_m.n > 0").select("_ql", F.col("_m.gram").alias("gram")).join(postings, "gram")
                 .filter(F.col("text").contains(F.col("_ql"))).groupBy("_ql").agg(F.min("Item_Code").alias("Item_Code")))
    sub = open_q.join(contained, "_ql").select(*keys, "_src", "_pos", F.lit(1).alias("_kind"), "Item_Code")
    best = exact.unionByName(sub).groupBy(*keys).agg(F.min(F.struct("_src", "_pos", "_kind", "Item_Code")).alias("_m"))
    return questions.select(*keys).join(best, keys, "left").select(*keys, F.col("_m.Item_Code").alias("Item_Code"))


PATTERN_MONTHS = 24  # window of the pattern routes
MASK_BRANDS = {"BAYER_MASK": "Bayer"}  # fixed value: brand families that are found by Brand_Mask


def route(questions: DataFrame, items: DataFrame, keys: list[str], brands: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    """N11 (+N12): the operator a question is routed to, with its arguments.

    ``items`` is the dimension (or any table with items and brands), ``brands`` and ``grams`` the indexes of names. The
    questions are written once and read from there by each of the lookups.

    Pattern questions route in the intended order overstock -> brand -> item -> all. A question without an intent
    that asks for an analysis and names a brand goes to the brand's two-year analysis, any other to SQL. A brand family
    has its mask in ``Route_Mask``.
    """
    questions = written(questions)
    tags = tag_rules(questions)
    j = tags.join(detect_brand(questions, items if brands is None else brands, keys), keys, "left").join(
        detect_item(questions, items, keys, grams), keys, "left")
    it, b, i = F.col("Intent"), F.col("Brand"), F.col("Item_Code")
    has_b, has_i = b.isNotNull(), i.isNotNull()
    deep = (F.col("Needs_Analysis") | F.col("Decline_Analysis")) & has_b
    r = (F.when(it.isNull(), F.when(deep, F.lit("brand_analysis")).otherwise(F.lit("sql")))
         .when(it == "coverage", F.when(has_b, F.lit("coverage_windows:brand")).otherwise(F.lit("coverage_windows:company")))
         .when(it == "coverage_loss", F.when(has_i, F.lit("coverage_loss:item"))
               .when(has_b, F.lit("coverage_loss:brand+new_lost_retained")).otherwise(F.lit("needs_entity")))
         .when(it == "comparison", F.when(has_b, F.lit("coverage_brand_vs_company")).otherwise(F.lit("needs_brand")))
         .when(it == "oos", F.when(F.col("Is_Classification") & has_i, F.lit("decline_cause"))
               .when(has_b, F.lit("oos_items:brand+multi_account_oos")).otherwise(F.lit("oos_items:all")))
         .when(it == "pattern", F.when(F.col("Overstock_Route"), F.lit("overstock_risk"))
               .when(has_b, F.lit("seasonal_items:brand+anomalies")).when(has_i, F.lit("item_pattern"))
               .otherwise(F.lit("seasonal_items:all")))
         .when(it == "supply_chain", F.when(has_b, F.lit("supply_chain_dashboard")).otherwise(F.lit("needs_brand"))))
    mask = F.lit(None).cast("string")
    for name, text in MASK_BRANDS.items():
        mask = F.when(b == name, F.lit(text)).otherwise(mask)
    return j.select(*keys, "Intent", r.alias("Route"), F.when(~b.isin(*MASK_BRANDS), b).alias("Route_Brand"), mask.alias("Route_Mask"),
                    i.alias("Route_Item"), F.col("Days").alias("Route_Days"), F.when(it == "pattern", F.lit(PATTERN_MONTHS)).alias("Route_Months"),
                    "Year1", "Year2", "Focus", "Overstock_Route")
