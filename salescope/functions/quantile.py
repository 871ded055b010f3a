"""Exact quantiles (linear interpolation) from a rank sketch and one counting pass.

1. ``percentile_approx`` is a mergeable rank sketch (Greenwald-Khanna): every task makes its own, and the merged one
   answers any percentage with a value whose rank is off by at most n / accuracy. Asking it ``MARGIN`` times that
   error below and above the quantile gives a bracket that is certain to hold the wanted ranks, but for the two
   definitions of a rank, which differ by one.
2. One pass counts the values: those inside the bracket value by value, those below it and above it in two sums, each
   with the value next to the bracket (which covers the difference of one). Counts are made before the shuffle, so a
   value that a third of the rows share is one row for each task.
3. Running sums over what is left (about ``2 * MARGIN / accuracy`` of the values, and fewer with ties) give each
   value's ranks. The values at ranks floor(q(n-1)) and ceil(q(n-1)) are interpolated, lo + (hi - lo) * frac, the
   definition used by SQL ``percentile_cont``. Should a rank not be found, the query stops with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10000
MARGIN = 3


def exact_quantile(df: DataFrame, value: Column | str, q: float, *, alias: str = "value",
                   accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One-row DataFrame with the q-quantile of ``value`` (NULL when there are no values)."""
    return exact_quantiles(df, {alias: (value, q)}, accuracy=accuracy)


def exact_quantiles(df: DataFrame, specs: dict, *, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Several exact quantiles in one pass: ``{alias: (column, q)}`` -> one row, one column per alias.

    The columns are stacked as (series, value) rows and every step is grouped by series.
    """
    names = list(specs)
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in specs.values()]
    qs = [float(q) for _, q in specs.values()]
    values = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), c.cast("double").alias("_v"))
                                            for i, c in enumerate(cols)])).alias("_e"))
              .select("_e._k", "_e._v").filter(F.col("_v").isNotNull()))
    off = MARGIN / accuracy
    asked = [max(q - off, 0.0) for q in qs] + [min(q + off, 1.0) for q in qs]
    sketch = values.groupBy("_k").agg(F.percentile_approx("_v", asked, accuracy).alias("_a"), F.count("_v").alias("_n"))
    at = F.col("_k") + 1
    quantile = F.element_at(F.array(*[F.lit(q) for q in qs]), at)
    bracket = sketch.select("_k", F.element_at("_a", at).alias("_from"), F.element_at("_a", at + len(qs)).alias("_to"),
                            ((F.col("_n") - 1).cast("double") * quantile).alias("_pos"))
    v = F.col("_v")
    side = F.when(v < F.col("_from"), -1).when(v > F.col("_to"), 1).otherwise(0)
    placed = values.join(F.broadcast(bracket), "_k").withColumn("_side", side)  # one row per series
    counted = placed.groupBy("_k", "_pos", "_side", F.when(F.col("_side") == 0, v).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    below = Window.partitionBy("_k").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_end", F.sum("_c").over(below)).withColumn("_begin", F.col("_end") - F.col("_c"))

    def value_at(rank: Column) -> Column:
        """The value of a rank, known inside the bracket and at the two places beside it."""
        inside = (F.col("_side") == 0) & (F.col("_begin") <= rank) & (rank < F.col("_end"))
        before = (F.col("_side") == -1) & (F.col("_end") - 1 == rank)
        after = (F.col("_side") == 1) & (F.col("_begin") == rank)
        return F.max(F.when(inside | before, F.col("_last")).when(after, F.col("_first")))

    pos = F.col("_pos")
    found = ranked.groupBy("_k", "_pos").agg(value_at(F.floor(pos)).alias("_lo"), value_at(F.ceil(pos)).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    value = F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).when(
        lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos)))
    per = found.select("_k", value.alias("_q"))
    return per.agg(*[F.max(F.when(F.col("_k") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
