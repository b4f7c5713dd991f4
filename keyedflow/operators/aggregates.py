"""Tumbling-window count and sum, as final values or as a changelog, with exact late drop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow import rules
from keyedflow.functions.exprs import as_double, as_text, value_field
from keyedflow.operators.running import CHUNK, running, with_hot_offset_chunk
from keyedflow.operators.skew import ROWS_PER_TASK

GROUP_MODES = ("GROUP_BY_KEY", "GROUP_BY")


@dataclass(frozen=True)
class Count:
    """Number of records."""

    alias: str

    def __post_init__(self):
        rules.required("alias", self.alias)

    def column(self, df: DataFrame) -> Column:
        return F.lit(1).cast("bigint")


@dataclass(frozen=True)
class Sum:
    """Double sum of a top-level field; missing or non-numeric counts as 0.0."""

    source_field: str
    alias: str

    def __post_init__(self):
        rules.required("source_field", self.source_field)
        rules.required("alias", self.alias)

    def column(self, df: DataFrame) -> Column:
        return as_double(df, value_field(df, self.source_field))


def grouped_inputs(
    df: DataFrame,
    aggregations: Sequence[Count | Sum],
    group_mode: str | None,
    key_extractor: Column | str | None,
    strict: bool,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Only what the aggregation needs: group key, time, arrival and one column per alias.

    Records with a null key or a null value take no part.
    """
    rules.aggregations(aggregations)
    rules.ordered(df, carried)
    if group_mode not in GROUP_MODES:
        raise ValueError(f"group_mode must be one of {GROUP_MODES}, got {group_mode!r}")
    if group_mode == "GROUP_BY":
        rules.required("key_extractor", key_extractor)
        key = as_text(df, key_extractor, strict)
    else:
        key = F.col("key")
    return df.select(
        key.alias("key"),
        "ts",
        *carried,
        F.col("value").isNotNull().alias("_present"),
        *[a.column(df).alias(input_name(i)) for i, a in enumerate(aggregations)],
    ).where(F.col("key").isNotNull() & F.col("_present")).drop("_present")


def input_name(i: int) -> str:
    return f"_in{i}"


def result_value(aggregations: Sequence[Count | Sum], start: Column, end: Column) -> Column:
    """Value struct; the window bounds come last and replace aliases of the same name."""
    fields = {a.alias: F.col(input_name(i)) for i, a in enumerate(aggregations)}
    fields |= {"windowStart": start, "windowEnd": end}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def fold_windows(inputs: DataFrame, aggregations: Sequence[Count | Sum], size_ms: int) -> DataFrame:
    """One row per key and window. Spark sums before it shuffles, so hot keys are no burden."""
    names = [input_name(i) for i in range(len(aggregations))]
    grouped = inputs.groupBy("key", F.window("ts", f"{size_ms} milliseconds").alias("w")).agg(
        *[F.sum(n).alias(n) for n in names], F.max("ts").alias("ts")
    )
    value = result_value(aggregations, F.unix_millis("w.start"), F.unix_millis("w.end"))
    return grouped.select("key", value.alias("value"), "ts")


def window_start(size_ms: int) -> Column:
    ms = F.unix_millis("ts")
    return ms - F.pmod(ms, F.lit(size_ms))


def drop_late(
    df: DataFrame,
    size: int | timedelta,
    grace: int | timedelta,
    by: str = "partition",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """Drop records that arrive after their window closed.

    A record stays iff ``window end > stream time - grace``, where stream time is the
    largest timestamp among the records of the same ``by`` partition that arrived so far,
    itself included. Exact per record, in arrival order ``(partition, offset)``. Another
    ``by`` column makes sense only when the records of one group come from one partition,
    as arrival between partitions is not recorded.
    """
    size_ms, grace_ms = rules.window_size(size, "TUMBLING"), rules.window_grace(grace)
    rules.ordered(df, [by, "partition", "offset"])
    rules.batch("window_aggregate_stream, whose grace drops late records", df)
    timed = with_hot_offset_chunk(df.withColumn("_stream_time", F.unix_millis("ts")), [by], rows_per_chunk)
    seen = running(timed, [by], ["partition", "offset"], {"_stream_time": "max"})
    end = window_start(size_ms) + size_ms
    return seen.where(end > F.col("_stream_time") - grace_ms).drop("_stream_time")


def window_aggregate(
    df: DataFrame,
    aggregations: Sequence[Count | Sum],
    size: int | timedelta,
    grace: int | timedelta | None = None,
    group_mode: str | None = "GROUP_BY_KEY",
    key_extractor: Column | str | None = None,
    window_type: str | None = "TUMBLING",
    stream_time_by: str = "partition",
    strict: bool = True,
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """Final count/sum per key and tumbling window: ``key, value{aliases, windowStart, windowEnd}, ts``.

    With ``grace`` late records are dropped exactly as they would be on arrival; without
    it the table is taken as complete and nothing is late.
    """
    size_ms = rules.window_size(size, window_type)
    rules.batch("window_aggregate_stream", df)
    if grace is None:
        inputs = grouped_inputs(df, aggregations, group_mode, key_extractor, strict)
    else:
        carried = sorted({"partition", "offset", stream_time_by} - {"key"})
        inputs = grouped_inputs(df, aggregations, group_mode, key_extractor, strict, carried)
        inputs = drop_late(inputs, size_ms, grace, stream_time_by, rows_per_chunk)
    return fold_windows(inputs, aggregations, size_ms)


def window_aggregate_changelog(
    df: DataFrame,
    aggregations: Sequence[Count | Sum],
    size: int | timedelta,
    grace: int | timedelta | None = None,
    group_mode: str | None = "GROUP_BY_KEY",
    key_extractor: Column | str | None = None,
    window_type: str | None = "TUMBLING",
    stream_time_by: str = "partition",
    strict: bool = True,
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every update of ``window_aggregate``: one row per record, with the totals so far.

    Rows keep the ``partition`` and ``offset`` of the record that caused them, so the
    changelog can feed another operator.
    """
    size_ms = rules.window_size(size, window_type)
    rules.batch("window_aggregate_stream in update mode", df)
    carried = sorted({"partition", "offset", stream_time_by} - {"key"})
    inputs = grouped_inputs(df, aggregations, group_mode, key_extractor, strict, carried)
    inputs = inputs.withColumn("_start", window_start(size_ms))
    # Chunks are planned before late records go, so that finding them doesn't take the late drop.
    inputs = with_hot_offset_chunk(inputs, ["key", "_start"], rows_per_chunk)
    if grace is not None:
        inputs = drop_late(inputs.withColumnRenamed(CHUNK, "_totals_chunk"), size_ms, grace, stream_time_by, rows_per_chunk)
        inputs = inputs.withColumnRenamed("_totals_chunk", CHUNK)
    folds = {input_name(i): "sum" for i in range(len(aggregations))} | {"ts": "max"}
    totals = running(inputs, ["key", "_start"], ["partition", "offset"], folds)
    value = result_value(aggregations, F.col("_start"), F.col("_start") + size_ms)
    return totals.select("key", value.alias("value"), "ts", "partition", "offset")
