"""Cutting the lineage of loops."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names. A folder of our own
    is set only where none is and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='trackloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A table written once to the shared folder and read back: its lineage is cut, its statistics are
    known, and a lost executor loses nothing. The shuffles behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Free the disk of shuffles that ended jobs have left: Spark deletes the files of a shuffle only once the
    driver's collector has found that no plan holds it, which may be many rounds of a loop later."""
    spark.range(1).collect()  # listeners hold the plan of the query whose end they saw last
    gc.collect()  # plans that Python holds
    spark._jvm.System.gc()


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for table in tables:
        if table is not None and hasattr(table, "stored_at"):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
