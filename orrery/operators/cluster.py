"""Sharding: consistent-hash routing, merging of shard results, coverage."""

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.ranking import ranked

VIRTUAL_NODES = 150
_MASK = (1 << 64) - 1


def ring_hash(key: str) -> int:
    """64-bit FNV-1a of the bytes, then mixed."""
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 & _MASK
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & _MASK
    return h ^ h >> 33


def ring(shards: list[str], virtual: int = VIRTUAL_NODES) -> list[tuple[int, str]]:
    return sorted((ring_hash(f"{s}-{i}"), s) for s in shards for i in range(virtual))


def route(rows: DataFrame, key: str, shards: list[str]) -> DataFrame:
    """Adds shard: the owner of the first ring point at or above the key's hash, or of the first. The ring's size is that of the cluster."""
    points = ring(shards)
    at, names = [p for p, _ in points], [s for _, s in points]

    @F.pandas_udf("string")
    def owner(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: names[bisect.bisect_left(at, ring_hash(k)) % len(at)])

    return rows.withColumn("shard", owner(F.col(key).cast("string")))


def distribution(routed: DataFrame) -> DataFrame:
    n = routed.groupBy("shard").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("shard", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))


def merge(partials: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """Global top k of shard results (qid, id, score): an id that several shards return counts once, with its largest score."""
    return ranked(partials.groupBy("qid", "id").agg(F.max("score").alias("score")), ["qid"], tie=tie, limit=k)


def coverage(responses: DataFrame) -> DataFrame:
    """(qid, answered, coverage, partial) of (qid, shard, ok)."""
    return responses.groupBy("qid").agg(F.count_if("ok").alias("answered"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("coverage"), (F.count_if("ok") < F.count("*")).alias("partial"))


def collections(parts: DataFrame) -> DataFrame:
    """(name, shards, vectors, same_schema) of (name, shard, dimensions, metric, vectors)."""
    return parts.groupBy("name").agg(F.countDistinct("shard").alias("shards"), F.sum("vectors").alias("vectors"), (F.countDistinct("dimensions", "metric") == 1).alias("same_schema"))


def page(rows: DataFrame, order: list[str], token: dict | None, size: int) -> DataFrame:
    """One page after a token, which holds the last row's order values; a range filter and a limit, no row numbers over all rows."""
    if token:
        cond: Column = F.lit(False)
        for i, c in enumerate(order):
            same = F.lit(True)
            for d in order[:i]:
                same = same & (F.col(d) == F.lit(token[d]))
            cond = cond | (same & (F.col(c) > F.lit(token[c])))
        rows = rows.filter(cond)
    return rows.orderBy(*order).limit(size)
