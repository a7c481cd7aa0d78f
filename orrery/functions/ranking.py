"""Ranking helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], score: str = "score", tie: str = "id", limit: int | None = None, digits: int | None = 6) -> DataFrame:
    """Adds rank from 1, by score descending and the tie column as text ascending, in each group of `by`. Scores are rounded first, so
    that engines agree on ties. With a limit, Spark cuts each partition before the exchange."""
    if digits is not None:
        df = df.withColumn(score, F.round(score, digits))
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie).cast("string"))
    out = df.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def decay(hop: Column, factor: float = 0.85) -> Column:
    return F.pow(F.lit(factor), hop)
