"""A global rank without a global task: the order of a whole table as data.

Rows are dealt into ranges of the order and sorted there. How many rows each range holds gives, summed over the ranges
before it (one small row a range), the rank that a range starts with; a row's rank is that and its place. The sorted
rows are written once, so both reads see the same ranges, and a lost executor recovers from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.session import written

PLACES = 1 << 33  # monotonically_increasing_id: the task's number above, the place within it below


def global_rank(df: DataFrame, order: list[Column], name: str = "Rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in ``order``; rows that the order does not tell apart get
    consecutive ranks. The result is unordered."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.expr(f"_at div {PLACES}L")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.expr(f"_at % {PLACES}L") + 1).alias(name))
