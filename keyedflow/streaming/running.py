"""Running operators on streams, exact per record: late drop, changelogs of totals, table joins.

Each is a step from the rows of a micro-batch to result rows. Inside a micro-batch a step folds in
arrival order as the batch operators do, hot keys in chunks; what earlier batches amount to comes from
a ``BucketTable``. A stream of steps gives the rows that the batch operator gives over the whole input,
however the input is cut, as long as records come in arrival order and those of a key from one
partition, as arrival between partitions is not recorded; what comes later than that is judged and paired
when it comes, as in any running operator. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow import rules
from keyedflow.operators.aggregates import Count, Sum, grouped_inputs, input_name, result_value, window_start
from keyedflow.operators.joins import ARRIVAL, flat_pairs, pair_order, tagged_arrivals
from keyedflow.operators.running import running, with_hot_offset_chunk, with_hot_time_chunk
from keyedflow.operators.skew import ROWS_PER_TASK
from keyedflow.streaming.tables import BUCKETS, BucketTable

Step = Callable[[DataFrame, int], DataFrame]


def with_held(rows: DataFrame, state: DataFrame, keys: Sequence[str], combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``rows`` with each column in ``combine`` brought together with the one that ``state`` holds for the key."""
    held = state.select(*keys, *[F.col(c).alias(f"_held_{c}") for c in combine])
    joined = rows.join(held, list(keys), "left")
    return joined.withColumns({c: f(F.col(c), F.col(f"_held_{c}")) for c, f in combine.items()}).drop(*[f"_held_{c}" for c in combine])


def merged(table: BucketTable, spark: SparkSession, news: DataFrame, batch_id: int, combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """State before the batch, after ``news`` (one row per key) were merged into it and written."""
    keys, touched = list(table.keys), table.touched(news)
    state = table.before(spark, batch_id, touched, news.schema)
    if touched:
        new, old = news.alias("n"), state.alias("o")
        both = new.join(old, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "full")
        whole = both.select(
            *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[f(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c, f in combine.items()]
        )
        table.write(whole, batch_id, touched)
    return state


def late_drop_step(table: BucketTable, size: int | timedelta, grace: int | timedelta, by: str = "partition", rows_per_chunk: int = ROWS_PER_TASK) -> Step:
    """``drop_late``; ``table`` (keyed by ``by``) keeps each partition's stream time."""
    size_ms, grace_ms = rules.window_size(size, "TUMBLING"), rules.window_grace(grace)
    combine = {"_stream_time": lambda new, held: F.greatest(new, held)}

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        rules.ordered(batch, [by, *ARRIVAL])
        timed = batch.withColumn("_stream_time", F.unix_millis("ts"))
        state = merged(table, batch.sparkSession, timed.groupBy(by).agg(F.max("_stream_time").alias("_stream_time")), batch_id, combine)
        seen = running(with_hot_offset_chunk(timed, [by], rows_per_chunk), [by], ARRIVAL, {"_stream_time": "max"})
        seen = with_held(seen, state, [by], combine)
        return seen.where(window_start(size_ms) + size_ms > F.col("_stream_time") - grace_ms).select(*batch.columns)

    return step


def inputs_step(
    aggregations: Sequence[Count | Sum], group_mode: str | None = "GROUP_BY_KEY", key_extractor: Column | str | None = None,
    by: str = "partition", strict: bool = True,
) -> Step:
    """What an aggregate takes of each record; records without key or value go, and move no stream time."""
    carried = sorted({by, *ARRIVAL} - {"key"})
    return lambda batch, _: grouped_inputs(batch, aggregations, group_mode, key_extractor, strict, carried)


def changelog_step(
    table: BucketTable, aggregations: Sequence[Count | Sum], size: int | timedelta, window_type: str | None = "TUMBLING",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> Step:
    """``window_aggregate_changelog`` over ``inputs_step``; ``table`` (keyed by key and _start) keeps the totals so far."""
    size_ms, keys = rules.window_size(size, window_type), ["key", "_start"]
    names = [input_name(i) for i in range(len(aggregations))]
    combine = {n: lambda new, held: F.coalesce(new, F.lit(0)) + F.coalesce(held, F.lit(0)) for n in names}
    combine["ts"] = lambda new, held: F.greatest(new, held)

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        inputs = batch.withColumn("_start", window_start(size_ms))
        news = inputs.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], F.max("ts").alias("ts"))
        state = merged(table, batch.sparkSession, news, batch_id, combine)
        folds = {n: "sum" for n in names} | {"ts": "max"}
        totals = running(with_hot_offset_chunk(inputs, keys, rows_per_chunk), keys, ARRIVAL, folds)
        totals = with_held(totals, state, keys, combine)
        value = result_value(aggregations, F.col("_start"), F.col("_start") + size_ms)
        return totals.select("key", value.alias("value"), "ts", *ARRIVAL)

    return step


def table_join_step(table: BucketTable, left_name: str, right_name: str, order_by: str = "ts", rows_per_chunk: int = ROWS_PER_TASK) -> Step:
    """``table_join_changelog`` over tagged arrivals; ``table`` keeps the latest record of both sides by key."""
    order, by_time = pair_order(order_by), order_by == "ts"
    combine = {c: lambda new, held: F.coalesce(new, held) for c in ("_left", "_right")}

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in combine]
        state = merged(table, batch.sparkSession, batch.groupBy("key").agg(*latest), batch_id, combine)
        chunked = (with_hot_time_chunk if by_time else with_hot_offset_chunk)(batch, ["key"], rows_per_chunk)
        paired = with_held(running(chunked, ["key"], order, {c: "last" for c in combine}), state, ["key"], combine)
        return flat_pairs(paired, left_name, right_name)

    return step


def step_stream(
    df: DataFrame, steps: Sequence[Step], folder: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> DataStreamWriter:
    """Every micro-batch through ``steps``, its results written to a folder of its own below ``folder``.

    Read them with ``read_steps``. Rows between steps are kept, not computed again.
    """
    rules.required("steps", list(steps))
    rules.required("folder", folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = [batch.persist()]
        try:
            for step in steps[:-1]:
                held.append(step(held[-1], batch_id).persist())
            out = steps[-1](held[-1], batch_id).write.mode("overwrite").partitionBy(*partition_by)
            out.parquet(f"{folder}/batch_id={batch_id}")
        finally:
            for rows in held:
                rows.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """All results of a ``step_stream`` so far."""
    return spark.read.parquet(folder).drop("batch_id")


def drop_late_stream(
    df: DataFrame, size: int | timedelta, grace: int | timedelta, folder: str, checkpoint: str, by: str = "partition",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataStreamWriter:
    """``drop_late`` on a stream: each record is judged by the stream time of its own partition when it arrives."""
    table = BucketTable(f"{checkpoint}/tables/stream_time", [by], 1)
    return step_stream(df, [late_drop_step(table, size, grace, by, rows_per_chunk)], folder, checkpoint)


def window_changelog_stream(
    df: DataFrame,
    aggregations: Sequence[Count | Sum],
    size: int | timedelta,
    folder: str,
    checkpoint: str,
    grace: int | timedelta | None = None,
    group_mode: str | None = "GROUP_BY_KEY",
    key_extractor: Column | str | None = None,
    window_type: str | None = "TUMBLING",
    stream_time_by: str = "partition",
    strict: bool = True,
    rows_per_chunk: int = ROWS_PER_TASK,
    buckets: int = BUCKETS,
) -> DataStreamWriter:
    """``window_aggregate_changelog`` on a stream: one update per record, whatever the micro-batches.

    Totals of all windows are kept, since a partition that has been silent may still add to any of
    them; with a ``grace``, late records are dropped first.
    """
    steps = [inputs_step(aggregations, group_mode, key_extractor, stream_time_by, strict)]
    if grace is not None:
        times = BucketTable(f"{checkpoint}/tables/stream_time", [stream_time_by], 1)
        steps.append(late_drop_step(times, size, grace, stream_time_by, rows_per_chunk))
    table = BucketTable(f"{checkpoint}/tables/totals", ["key", "_start"], buckets)
    steps.append(changelog_step(table, aggregations, size, window_type, rows_per_chunk))
    return step_stream(df, steps, folder, checkpoint)


def table_join_changes_stream(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    folder: str,
    checkpoint: str,
    join_type: str | None = "INNER",
    strict: bool = True,
    order_by: str = "ts",
    rows_per_chunk: int = ROWS_PER_TASK,
    buckets: int = BUCKETS,
) -> DataStreamWriter:
    """``table_join_changelog`` on two streams, with the latest records in a table instead of Python state.

    Records count by micro-batch and, within one, in ``order_by`` order.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    table = BucketTable(f"{checkpoint}/tables/latest", ["key"], buckets)
    step = table_join_step(table, left_name, right_name, order_by, rows_per_chunk)
    return step_stream(tagged_arrivals(left, right, select_key, strict), [step], folder, checkpoint)
