"""Streams over contents that repeat across files and micro-batches."""

import datetime

from pyspark.sql import functions as F

from orrery.plans import ingest


def test_stream_dedup_takes_the_least_id_in_any_order(spark, tmp_path):
    """The least ids come last and 200 days late; null contents are one."""
    n = (F.col("event_id") / 15).cast("int")
    e = spark.range(0, 3000, 1, 1).select((2999 - F.col("id")).alias("event_id"))
    e = e.withColumn("ts", (F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(n)).cast("timestamp_ntz"))
    e = e.withColumns({"user_id": F.lit(1).cast("long"), "event_type": F.lit("x"), "value": F.lit(1.0), "props": F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 7).cast("string"))})
    e.repartitionByRange(25, F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["props"]: r["event_id"] for r in ingest.stream_dedup(spark, str(tmp_path)).collect()}
    assert got == {None: 0, **{str(i): i for i in range(1, 7)}}
