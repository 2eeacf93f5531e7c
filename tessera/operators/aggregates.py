"""Set aggregates over many fingerprints of a group: counted by position, so a group never meets in one task as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_votes(rows: DataFrame, keys: list[str], keep: Column, positions: str = "positions") -> DataFrame:
    votes = rows.select(*keys, F.explode(positions).alias("_p")).groupBy(*keys, "_p").agg(F.count("*").alias("votes"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("members"))
    return votes.join(n, keys).where(keep).groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias(positions))


def union_agg(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _by_votes(rows, keys, F.lit(True))


def intersection_agg(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _by_votes(rows, keys, F.col("votes") == F.col("members"))


def xor_agg(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _by_votes(rows, keys, F.col("votes") % 2 == 1)


def center(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of more than half (rounded down) of a group's members."""
    return _by_votes(rows, keys, F.col("votes") > F.floor(F.col("members") / 2))
