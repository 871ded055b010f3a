"""SQL surface and catalog helpers (SRC5, SRC9-SRC11, SRC13).

``execute_query`` runs one SELECT over the four tables and returns ``(df, error)``: the text of an
error, whether of planning or of running, instead of an exception.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions.expr import dim, not_blank
from salescope.session import checkpoint_dir
from salescope.sources.tables import TABLE_NAMES, Tables


def execute_query(spark: SparkSession, tables: Tables, sql: str, args: dict | None = None, *, run: bool = True):
    """SRC5: one SELECT over the four tables; ``(DataFrame, None)`` or ``(None, message)``.

    The text stands inside a subquery, so nothing but a query parses. The tables' names are views only while it is
    planned; views the caller has under these names come back. With ``run`` the rows are written once to the
    checkpoint folder, which brings errors of running to light; otherwise the result stays lazy. Values can be bound
    with ``args`` (named parameters) instead of being spliced into the text.
    """
    own = {n: spark.table(n) for n in TABLE_NAMES if any(v.name == n and v.isTemporary for v in spark.catalog.listTables())}
    try:
        tables.register(spark)
        df = spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n) AS result", args=args)
        if run:
            checkpoint_dir(spark)
            df = df.checkpoint()
        return df, None
    except (PySparkException, Py4JJavaError) as e:
        return None, str(e)
    finally:
        for n in TABLE_NAMES:
            if n in own:
                own[n].createOrReplaceTempView(n)
            else:
                spark.catalog.dropTempView(n)


def _quoted(name: str) -> str:
    """A table name of one to three parts as quoted identifiers."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def register_table(spark: SparkSession, name: str, path: str) -> None:
    """An external catalog table over a stored folder (partitioning inferred), partitions recovered."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def analyze(spark: SparkSession, table: str) -> None:
    """SRC9: column statistics for the cost-based optimizer (catalog tables only)."""
    spark.sql(f"ANALYZE TABLE {_quoted(table)} COMPUTE STATISTICS FOR ALL COLUMNS")


def table_info(tables: Tables) -> dict[str, list[tuple[str, str]]]:
    """SRC10: (column, type) per table, from the DataFrame schema (no job)."""
    return {n: [(f.name, f.dataType.simpleString()) for f in getattr(tables, n).schema.fields] for n in TABLE_NAMES}


def rows_per_year(sales: DataFrame) -> DataFrame:
    """SRC11: rows per Year."""
    return sales.groupBy("Year").agg(F.count(F.lit(1)).alias("Row_Count")).orderBy("Year")


def top_brands_by_rows(sales: DataFrame, n: int = 5) -> DataFrame:
    """SRC11: the ``n`` brands with most rows (ties by brand name)."""
    return (sales.groupBy("Brand").agg(F.count(F.lit(1)).alias("Row_Count"))
            .orderBy(F.col("Row_Count").desc(), "Brand").limit(n))


def load_totals(t: Tables) -> DataFrame:
    """SRC11: row counts of the four tables and the number of distinct brands, as one row.

    Each count is a separate global aggregate (partial counts per task, one tiny final stage);
    the one-row results are combined with a cross join of single rows.
    """
    parts = [
        t.sales.agg(F.count(F.lit(1)).alias("Sales_Rows"), F.countDistinct("Brand").alias("Distinct_Brands")),
        t.target.agg(F.count(F.lit(1)).alias("Target_Rows")),
        t.sales_summary.agg(F.count(F.lit(1)).alias("Sales_Summary_Rows")),
        t.target_summary.agg(F.count(F.lit(1)).alias("Target_Summary_Rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # 1 row x 1 row
    return out


def selector(sales_summary: DataFrame, column: str, *, year: int | None = None, non_blank: bool = False) -> DataFrame:
    """SRC13: ordered distinct values of one column for a year (GM: not NULL and not '')."""
    df = sales_summary if year is None else sales_summary.filter(F.col("Year") == F.lit(year))
    if non_blank:
        df = df.filter(not_blank(column))
    return df.select(dim(column)).distinct().orderBy(column)
