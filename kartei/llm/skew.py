"""Joins whose keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 16


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, ways: int = WAYS) -> DataFrame:
    """Inner join in which a key's rows of ``big`` go to several tasks, by a hash of ``by``; ``small`` is repeated for each.

    small must have few rows a key. Where the planner broadcasts small, the salt costs nothing but the repeated rows.
    """
    left = big.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    right = small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [*on, "_way"]).drop("_way")
