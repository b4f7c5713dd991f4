"""Streaming form of the windowed aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame

from keyedflow import rules
from keyedflow.operators.aggregates import Count, Sum, fold_windows, grouped_inputs


def window_aggregate_stream(
    df: DataFrame,
    aggregations: Sequence[Count | Sum],
    size: int | timedelta,
    grace: int | timedelta,
    group_mode: str | None = "GROUP_BY_KEY",
    key_extractor: Column | str | None = None,
    window_type: str | None = "TUMBLING",
    strict: bool = True,
) -> DataFrame:
    """``window_aggregate`` on a stream; ``grace`` becomes the watermark delay.

    Write it in ``update`` mode for changed totals after each micro-batch, or in ``append``
    mode for one final row per window once the watermark has passed it. Lateness is judged
    per micro-batch; ``settings.strict_lateness`` keeps Spark from allowing one batch more.
    """
    size_ms, grace_ms = rules.window_size(size, window_type), rules.window_grace(grace)
    timed = df.withWatermark("ts", f"{grace_ms} milliseconds")
    inputs = grouped_inputs(timed, aggregations, group_mode, key_extractor, strict)
    return fold_windows(inputs, aggregations, size_ms)
