"""Text-matching expressions for question tagging.

Keyword tests are plain substring tests on the lower-cased text (``contains``), as in the
reference. "Word" characters are Unicode letters, digits and underscore (Python's ``\\w``), and a
word boundary at position p holds when exactly one of the characters at p-1 and p is a word
character (text edges count as non-word), which is Python's ``\\b`` on ``str``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"


def any_keyword(text_lower: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text_lower.contains(k) for k in keywords])


def first_label(text_lower: Column, rules: list[tuple[str, list[str]]], default=None) -> Column:
    """Label of the first rule whose keyword list hits (ordered ``when`` chain)."""
    expr = F.lit(default).cast("string")
    for label, kws in reversed(rules):
        expr = F.when(any_keyword(text_lower, kws), F.lit(label)).otherwise(expr)
    return expr


def is_word_char(ch: Column) -> Column:
    """Whether a one-character string is a word character ('' and NULL are not)."""
    return F.coalesce(ch.rlike(f"^{WORD_CHAR}$"), F.lit(False))
