"""Finding groups too large for one task.

Counting is exact and aggregates before it shuffles; only the group hash and a few
numbers move. A group is hot when it has more rows than ``rows_per_task``, so there is at
most one hot group for so many rows (a million by default): a trillion rows have a few tens
of MB of them, which can be broadcast. Hash collisions are harmless: a
small group that shares a hash with a hot one is merely split as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def spread(df: DataFrame) -> Column:
    """Hash that tells records apart and is the same whenever they are read again."""
    if {"partition", "offset"} <= set(df.columns):
        return F.xxhash64("partition", "offset")
    return F.xxhash64("ts", F.to_json("value"))


def hot_groups(
    df: DataFrame, group: Column, rows_per_task: int, measures: dict[str, Column] | None = None
) -> DataFrame:
    """Hot groups as ``(_hash, _rows, measures...)``; ``group`` is a hash column over ``df``."""
    counted = df.groupBy(group.alias("_hash")).agg(
        F.count(F.lit(1)).alias("_rows"), *[m.alias(name) for name, m in (measures or {}).items()]
    )
    return counted.where(F.col("_rows") > rows_per_task)
