"""Shared helpers: shared-folder tables, size-checked lookups, reading the inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.stage import shared_dir, stored  # noqa: F401

#: ASCII white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Copies of a lookup row in a shuffled lookup, so that one key's rows are dealt to as many tasks.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """left outer join to a table with one row a key. right is broadcast only if its counted rows are at most BROADCAST_ROWS;
    else both sides are shuffled by key and salt, so that a key with a third of the rows spreads over SALTS tasks.
    Null keys match nothing."""
    if rows is None:
        rows = right.count()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"], "left").drop("__salt")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def process_cache(name: str, make):
    """What make() gave when first asked for `name` in this process; Python workers serve many tasks."""
    import sys
    import types

    held = sys.modules.setdefault("_orrery_process_cache", types.ModuleType("_orrery_process_cache")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
