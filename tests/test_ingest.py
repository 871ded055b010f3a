"""Sources and sinks: yearly ingest, name cleaning, stored layout round trip, CSV export, SQL surface."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from salescope.session import checkpoint_dir
from salescope.sources import catalog, ingest
from salescope.sources.tables import TABLE_NAMES, load_tables


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def test_clean_columns_and_year_label():
    assert ingest.clean_column("Item Code") == "Item_Code"
    assert ingest.clean_column("R&D Spend.") == "RandD_Spend"
    assert ingest.year_of_label("2024 Sales") == 2024


def test_yearly_csv_ingest_round_trip(spark, tables):
    root = scratch(spark, "extracts")
    src = tables.sales.drop("Year")
    raw_names = {c: c.replace("_", " ") for c in src.columns}
    extracts = {}
    for y in (1999, 2000):
        p = f"{root}/y{y}"
        src.filter(F.year("Invoice_Date") == y).select(
            *[F.col(f"`{c}`").cast("string").alias(n) for c, n in raw_names.items()]).write.option(
            "header", True).csv(p)
        extracts[f"{y} Sales"] = p
    got = ingest.read_yearly(spark, extracts, fmt="csv")
    exp = tables.sales.filter(F.col("Year").isin(1999, 2000))
    assert got.count() == exp.count()
    assert {r["Year"] for r in got.select("Year").distinct().collect()} == {1999, 2000}
    a = got.agg(F.sum("Amount")).collect()[0][0]
    b = exp.agg(F.sum("Amount")).collect()[0][0]
    assert a == b


def test_stored_layout_round_trip(spark, tables):
    root = scratch(spark, "stored")
    ingest.write_tables(tables, root)
    stored = load_tables(spark, root)
    for name in TABLE_NAMES:
        assert getattr(stored, name).count() == getattr(tables, name).count(), name
    assert glob.glob(f"{root}/sales/Year=2000/*/*.parquet")


def test_csv_export_has_header(spark, tables):
    out = scratch(spark, "export")
    ingest.export_csv(tables.sales_summary.limit(3), out)
    first = open(sorted(glob.glob(f"{out}/*.csv"))[0]).readline()
    assert first.startswith("Year,Month_and_Year")


def test_execute_query_returns_rows_or_error(spark, tables):
    df, err = catalog.execute_query(spark, tables, "SELECT Year, COUNT(*) AS n FROM sales WHERE Year = :y GROUP BY Year",
                                    {"y": 2000})
    assert err is None and df.collect()[0]["n"] > 0
    df, err = catalog.execute_query(spark, tables, "SELECT no_such_column FROM sales")
    assert df is None and "no_such_column" in err
    assert df is None
    df, err = catalog.execute_query(spark, tables, "SELECT 1 / (Year - Year) AS x FROM sales ORDER BY x;")
    assert df is None and "DIVIDE_BY_ZERO" in err
    df, err = catalog.execute_query(spark, tables, "SELECT Brand FROM sales -- all\n WHERE Brand = 'Brand#1' LIMIT 2")
    assert err is None and df.count() == 2
    info = catalog.table_info(tables)
    assert ("Amount", "decimal(18,2)") in info["sales"] and ("Total_Target", "decimal(28,2)") in info["target_summary"]


def test_execute_query_takes_one_select_and_leaves_views_alone(spark, tables):
    spark.range(3).createOrReplaceTempView("sales")
    spark.range(2).createOrReplaceTempView("mine")
    for ddl in ("DROP VIEW mine", "CREATE TEMP VIEW other AS SELECT 1", "SELECT 1; DROP VIEW mine"):
        df, err = catalog.execute_query(spark, tables, ddl)
        assert df is None and err
    df, err = catalog.execute_query(spark, tables, "SELECT count(*) AS n FROM sales")
    assert err is None and df.first().n == tables.sales.count()
    assert spark.table("sales").count() == 3 and spark.table("mine").count() == 2
    assert not any(v.name == "target" for v in spark.catalog.listTables())
    for name in ("sales", "mine"):
        spark.catalog.dropTempView(name)


def test_analyze_collects_column_statistics(spark, tables):
    root = scratch(spark, "analyzed")
    ingest.write_tables(tables, root)
    name = f"sales_{uuid.uuid4().hex[:8]}"
    catalog.register_table(spark, name, f"{root}/sales")
    assert spark.table(name).count() == tables.sales.count()
    catalog.analyze(spark, name)
    stats = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {name} Brand").collect()}
    assert abs(int(stats["distinct_count"]) - 25) <= 2 and stats["num_nulls"] == "0"  # NDV is an HLL estimate
    spark.sql(f"DROP TABLE {name}")


def test_month_labels_agree_with_the_year(spark, tables):
    root = scratch(spark, "labels")
    rows = tables.target.where("Year = 1999").limit(5)
    label, sort = F.col("Month_and_Year"), F.col("Month_and_Year_Sort")
    rows.withColumn("Month_and_Year", F.concat(F.lit(" "), label, F.lit("  "))).write.parquet(f"{root}/blank")
    got = ingest.read_target(spark, f"{root}/blank").collect()
    assert sorted(r.Month_and_Year for r in got) == sorted(r.Month_and_Year for r in rows.collect())
    bad = {"short": (F.lit("Jan-25"), sort), "other": (F.lit("Dec 1998"), sort), "sort": (label, sort + 100)}
    for name, (own, key) in bad.items():
        rows.withColumns({"Month_and_Year": own, "Month_and_Year_Sort": key.cast("int")}).write.parquet(f"{root}/{name}")
        with pytest.raises(Exception, match="does not agree with year"):
            ingest.read_target(spark, f"{root}/{name}").collect()
    sales = tables.sales.where("Year = 1999").limit(5).drop("Year").withColumn("Month_and_Year", F.lit("Dec 1998"))
    sales.write.parquet(f"{root}/sales")
    with pytest.raises(Exception, match="does not agree with year"):
        ingest.read_yearly(spark, {"1999 Sales": f"{root}/sales"}).collect()
