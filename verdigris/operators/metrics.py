"""Gold metrics over facts and dimensions, for any year and any names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_year


def quarter_pivot(facts: DataFrame, ts: str, year: int, by: Sequence[str]) -> DataFrame:
    """Per group of (already joined) facts the number in each quarter of the year: Q1..Q4."""
    quarters = [F.sum(F.when(F.quarter(ts) == q, 1).otherwise(0)).cast("long").alias(f"Q{q}") for q in (1, 2, 3, 4)]
    return facts.where(in_year(F.col(ts), year)).groupBy(*by).agg(*quarters)


def counts_in_year(facts: DataFrame, ts: str, year: int, key: str, name: str = "hired") -> DataFrame:
    return facts.where(in_year(F.col(ts), year)).groupBy(key).agg(F.count("*").alias(name))


def above_average(counts: DataFrame, name: str = "hired") -> DataFrame:
    """Groups strictly above the mean over the groups that have any. The mean is one row, computed from one
    row per group."""
    mean = counts.agg(F.avg(name).alias("_mean"))
    return counts.crossJoin(F.broadcast(mean)).where(F.col(name) > F.col("_mean")).drop("_mean")
