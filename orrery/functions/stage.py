"""Cutting lineage: tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all runs on this machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        known = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: loops over it don't repeat its plan, and lost executors cost nothing.
    by: a column whose values get a folder each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder then stays to its owner
        pass


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
