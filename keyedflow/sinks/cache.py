"""Key-value sinks: last value per key, or the list of all values per key.

The rows these return are what a key-value store would hold. A list is kept as rows
``(key, position, value)`` instead of one array per key, since one key may own a large
part of all records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow import rules
from keyedflow.functions.exprs import as_text
from keyedflow.operators.joins import ARRIVAL, latest_by_key
from keyedflow.operators.running import running, with_hot_offset_chunk
from keyedflow.operators.skew import ROWS_PER_TASK

MODES = ("SET", "LIST_APPEND")


def cache_entries(
    df: DataFrame, key_expr: Column | str, strict: bool = True, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Records under their cache key, with the columns that order them.

    A null value cannot be cached and raises when strict.
    """
    rules.required("key_expr", key_expr)
    rules.ordered(df, order)
    value = F.col("value")
    if strict:
        value = F.when(value.isNotNull(), value).otherwise(
            F.raise_error(F.lit("a null value cannot be cached")).cast(df.schema["value"].dataType)
        )
    return df.select(as_text(df, key_expr, strict).alias("key"), value.alias("value"), *order)


def cache_set(
    df: DataFrame, key_expr: Column | str, strict: bool = True, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Last value written under each rendered key: ``key, value``."""
    rules.batch("cache_stream", df)
    entries = cache_entries(df, key_expr, strict, order)
    return latest_by_key(entries, order=order).select("key", "value")


def cache_list(
    df: DataFrame, key_expr: Column | str, strict: bool = True, rows_per_chunk: int = ROWS_PER_TASK
) -> DataFrame:
    """Every value appended under each rendered key, in arrival order: ``key, position, value``."""
    rules.batch("cache_stream", df)
    entries = with_hot_offset_chunk(cache_entries(df, key_expr, strict), ["key"], rows_per_chunk)
    counted = running(entries.withColumn("position", F.lit(1).cast("bigint")), ["key"], ARRIVAL, {"position": "sum"})
    return counted.select("key", (F.col("position") - 1).alias("position"), "value")


def cache_sink(df: DataFrame, key_expr: Column | str, mode: str | None = "SET", strict: bool = True) -> DataFrame:
    """``cache_set`` or ``cache_list`` by mode name."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return cache_set(df, key_expr, strict) if mode == "SET" else cache_list(df, key_expr, strict)
