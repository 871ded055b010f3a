"""Ingest and storage of the four tables (SRC1-SRC4, SRC8, SRC12).

The reference loads one workbook sheet per year, normalises column names, adds ``Year`` from the
sheet name and appends to one table. Here each yearly extract is a CSV or Parquet path read with
the fixed schema, the year is a literal column, and the union is written once, partitioned by
``Year`` (the partition column replaces the reference's per-column indexes: year filters prune
files, and the writer sorts within partitions by Brand and date so Parquet min/max statistics
skip row groups for brand and date predicates). Month labels are trimmed; a label that does not end
with its row's year, by which the marts are stored and joined, stops the ingest.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.sources import marts, names, rollups
from salescope.sources.schema import SALES, TARGET, validate
from salescope.sources.tables import Tables


def clean_column(name: str) -> str:
    """SRC3: space -> '_', '&' -> 'and', '.' removed."""
    return name.replace(" ", "_").replace("&", "and").replace(".", "")


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_column(c) for c in df.columns])


def year_of_label(label: str) -> int:
    """first whitespace token of a sheet label ('2024 Sales') as the year."""
    return int(label.split()[0])


def read_extract(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def checked_months(df: DataFrame) -> DataFrame:
    """Trimmed month labels; a row whose label or sort key is of another year than ``Year`` raises when it is read."""
    label = F.trim("Month_and_Year")
    year = F.expr("try_cast(right(trim(Month_and_Year), 4) AS INT)")
    other = ~year.eqNullSafe(F.col("Year")) | F.coalesce(F.floor(F.col("Month_and_Year_Sort") / 100) != F.col("Year"), F.lit(False))
    text = F.concat(F.lit("month label '"), label, F.lit("' ("), F.coalesce(F.col("Month_and_Year_Sort").cast("string"), F.lit("no sort key")),
                    F.lit(") does not agree with year "), F.coalesce(F.col("Year").cast("string"), F.lit("null")))
    return df.withColumn("Month_and_Year", F.when(label.isNotNull() & other, F.raise_error(text)).otherwise(label))


def read_yearly(spark: SparkSession, extracts: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """SRC1: one extract per labelled year -> cleaned names + literal Year -> union by name."""
    frames = []
    for label, path in extracts.items():
        df = clean_columns(read_extract(spark, path, fmt)).withColumn("Year", F.lit(year_of_label(label)))
        frames.append(df)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return checked_months(validate(merged, SALES, "sales"))


def read_target(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC2: the target extract, same cleaning and schema validation."""
    return checked_months(validate(clean_columns(read_extract(spark, path, fmt)), TARGET, "target"))


def write_fact(df: DataFrame, path: str, *, mode: str = "overwrite", sort_cols=("Brand", "Invoice_Date"), load: str = "base") -> None:
    """SRC4/SRC8: replace (overwrite) or append, partitioned by Year and load, sorted within partitions.

    Range partitioning on (Year, sort columns) samples the keys, so a year or brand holding a
    large share of the rows is split over many tasks instead of landing in one. ``mode="load"`` replaces nothing but
    the partitions of this very load.
    """
    cols = [c for c in sort_cols if c in df.columns]
    out = df.repartitionByRange("Year", *cols).sortWithinPartitions("Year", *cols).withColumn("load", F.lit(load))
    writer = out.write.partitionBy("Year", "load")
    if mode == "load":
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).parquet(path)


#: What is made from a fact and kept beside it, a partition a year: name -> (fact, function).
DERIVED = {
    "sales_summary": ("sales", marts.sales_summary),
    "target_summary": ("target", marts.target_summary),
    "item_days": ("sales", rollups.item_days),
    "items": ("sales", rollups.items),
    "accounts": ("sales", rollups.accounts),
    "brand_names": ("sales", lambda sales: names.brand_names(rollups.items(sales))),
    "item_grams": ("sales", lambda sales: names.item_grams(rollups.items(sales))),
}


def refresh(spark: SparkSession, root: str, *, fact: str | None = None, years: list[int] | None = None) -> None:
    """Make the derived tables anew from the stored facts: all of them, or only the partitions of some years.

    The facts are read back, so each is computed once and the written table is the recovery point. Where
    ``years`` are given, other partitions keep their files.
    """
    for name, (source, build) in DERIVED.items():
        if fact in (None, source):
            rows = spark.read.parquet(f"{root}/{source}").drop("load")
            if years is not None:
                rows = rows.filter(F.col("Year").isin(years))
            mode = "static" if years is None else "dynamic"
            build(rows).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("Year").parquet(f"{root}/{name}")


def write_tables(t: Tables, root: str, *, mode: str = "overwrite") -> None:
    """Write the two facts, then the marts, the rollup and the dimensions (SRC4, SRC6-SRC8) from the written facts."""
    root = root.rstrip("/")
    write_fact(t.sales, f"{root}/sales", mode=mode)
    write_fact(t.target, f"{root}/target", mode=mode, sort_cols=("Brand",))
    refresh(t.sales.sparkSession, root)


MANIFEST = "loads"
MANIFEST_SCHEMA = "fact string, load string, source string, row_count bigint, years array<int>"


def content_id(df: DataFrame, source: str) -> tuple[str, int, list[int]]:
    """Name of a load by what it holds: its source's name and a digest of its rows in any order; its rows and years."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    again = F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("a"), F.sum(again).alias("b"), F.array_sort(F.collect_set("Year")).alias("years")).first()
    name = f"{source}|{found.n}|{found.a}|{found.b}"
    return hashlib.sha256(name.encode()).hexdigest()[:24], found.n, found.years


def loads(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row for each load that was added to a stored fact."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root.rstrip('/')}/{MANIFEST}")
    except AnalysisException:  # nothing was loaded yet
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def append_load(spark: SparkSession, root: str, fact: str, df: DataFrame, source: str) -> bool:
    """Add an extract to a stored fact, once: False where the manifest has it already.

    ``source`` names the extract (a file or sheet), so equal rows of two sources are two loads and one source loaded
    again is none. A load writes its own partitions, ``Year=.../load=<id>``, then the derived tables of its years, then
    its line of the manifest. A run that stopped anywhere may simply be repeated: it replaces its own partitions.
    Partitions of other years and other loads keep their files.
    """
    root = root.rstrip("/")
    schema, sort_cols = {"sales": (SALES, ("Brand", "Invoice_Date")), "target": (TARGET, ("Brand",))}[fact]
    rows = checked_months(validate(df, schema, fact))
    load, n, years = content_id(rows, source)
    if not loads(spark, root).filter((F.col("fact") == fact) & (F.col("load") == load)).isEmpty():
        return False
    write_fact(rows, f"{root}/{fact}", mode="load", sort_cols=sort_cols, load=load)
    refresh(spark, root, fact=fact, years=years)
    line = spark.createDataFrame([(fact, load, source, n, years)], MANIFEST_SCHEMA)
    line.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fact", "load").parquet(f"{root}/{MANIFEST}")
    return True


_SAFE = re.compile(r"^[A-Za-z0-9_\-./:]+$")


def export_csv(df: DataFrame, path: str) -> None:
    """SRC12: a report as CSV with a header (one folder of part files, written by the executors)."""
    if not _SAFE.match(path):
        raise ValueError(f"unsafe export path {path!r}")
    df.write.mode("overwrite").option("header", True).csv(path)
