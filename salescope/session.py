"""Session helpers.

The library never creates a session behind the caller's back; these helpers are for
scripts, tests and the bench. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session (the shared folder a cluster names) and only falls back to a scratch folder when the
setting is absent, as in local tests.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "salescope") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SALESCOPE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def written(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new folder of its own under the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/kept-{uuid4().hex}"


def kept(df: DataFrame, at: str | None = None) -> DataFrame:
    """As ``written``, but as a compressed table of which a reader takes the columns it needs. Once it stands, Spark is
    asked to let go of the shuffle files it was made from, so that a query's steps do not lie on disk all at a time."""
    spark = df.sparkSession
    at = at or folder(spark)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    for _ in range(2):  # frames that are no longer used hold their shuffle files, and are let go in two turns
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def dropped(spark: SparkSession, at: str) -> None:
    """Removes what ``kept`` wrote to a folder; no frame may read it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the one the session names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a scratch folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so an unset setting is an error there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="salescope-ckpt-")
    sc.setCheckpointDir(own)
    return own
