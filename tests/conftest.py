import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from salescope.session import checkpoint_dir

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from salescope import star_tables

    return star_tables(spark, SF_SMALL)


def rows(df, *cols):
    """Collected rows as dicts (optionally only some columns)."""
    out = [r.asDict() for r in df.collect()]
    if cols:
        out = [{c: r[c] for c in cols} for r in out]
    return out
