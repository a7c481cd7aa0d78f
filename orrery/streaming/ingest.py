"""Structured Streaming: idempotent ingestion and ordered apply."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(stream: DataFrame, content: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """One row of each content within the watermark, by sha-256: the one that comes first. Which of a micro-batch's rows that is, is open
    (least_seen has it by a column). The state is bounded by the watermark, and later rows are dropped."""
    keyed = stream.withColumn("sha256", F.sha2(F.col(content), 256)).withWatermark(event_time, delay)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])


def least_seen(stream: DataFrame, content: str, order: str) -> DataFrame:
    """(content, order): the least order of each content among all rows so far, in whatever order they come. In update mode a batch has the
    contents it touched; the least of a content's rows is the answer. The state is one row a content, with no watermark: no row is late."""
    return stream.groupBy(content).agg(F.min(order).alias(order))


def idempotent_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes each micro-batch to a folder of its own, named by the batch: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_failures(df: DataFrame, good: str, dead: str, checkpoint: str):
    """Rows by route (see orrery.operators.mutations): dead letters to one folder, all others to the other."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("route = 'dead_letter'").write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        batch.filter("route <> 'dead_letter'").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered_apply(stream: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, sequence, status) of a stream of mutations: each key's sequences are applied from 1 without gaps. One that comes early waits in
    the state, what was applied before is a duplicate. The state holds the last applied sequence and the waiting ones only."""
    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, sequence long, status string"

    def apply(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        applied, waiting = state.getOption or (0, [])
        held, rows = set(waiting), []
        for b in batches:
            for s in sorted(b[sequence].tolist()):
                if s <= applied or s in held:
                    rows.append((s, "duplicate"))
                else:
                    held.add(int(s))
                while applied + 1 in held:
                    applied += 1
                    held.discard(applied)
                    rows.append((applied, "applied"))
        state.update((applied, sorted(held)))
        yield pd.DataFrame({key: [k[0]] * len(rows), "sequence": [r[0] for r in rows], "status": [r[1] for r in rows]})

    return stream.groupBy(key).applyInPandasWithState(apply, out, "applied long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def document_states(stream: DataFrame) -> DataFrame:
    """(doc_id, state, n_events): the furthest state of each document; a failure is final."""
    order = F.element_at(F.create_map(*[x for i, s in enumerate(("queued", "parsing", "chunking", "embedding", "inserting", "completed", "failed")) for x in (F.lit(s), F.lit(i))]), F.col("state"))
    return stream.groupBy("doc_id").agg(F.max_by("state", order).alias("state"), F.count("*").alias("n_events"))


def batch_size(queue: int, busy: float, most: int = 1000, least: int = 10) -> int:
    """Files a trigger takes: in proportion to the queue, halved when the workers are over 80 % busy."""
    n = max(least, min(most, queue))
    return max(least, n // 2) if busy > 0.8 else n
