"""Interval join of two streams, and joins of two tables kept as latest value per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow import rules
from keyedflow.functions.exprs import all_of, as_text
from keyedflow.operators.running import running, with_hot_offset_chunk, with_hot_time_chunk
from keyedflow.operators.skew import ROWS_PER_TASK, hot_groups, spread

ARRIVAL = ("partition", "offset")
# Length of a time bucket in join windows. A right record is copied to a second bucket when
# it is within a window of a border, so of eight windows one record in four is; longer buckets
# copy less but compare more records that are too far apart.
BUCKET_WINDOWS = 8


def joined_value(left_name: str, left: Column, right_name: str, right: Column) -> Column:
    """Value holding both records, original keys included, under the side names."""
    return F.struct(left.alias(left_name), right.alias(right_name))


def record(key: str = "key", value: str = "value") -> Column:
    return F.struct(F.col(key).alias("key"), F.col(value).alias("value"))


def _bucket(ms: Column, bucket_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(bucket_ms))


def _interval_side(df: DataFrame, select_key: Column | str, strict: bool) -> DataFrame:
    return df.select(
        as_text(df, select_key, strict).alias("key"),
        record().alias("record"),
        F.unix_millis("ts").alias("ms"),
        spread(df).alias("_spread"),
    )


def _with_split(side: DataFrame, splits: DataFrame, own: str, other: str) -> DataFrame:
    """Put each row of a hot group into one of its ``own`` splits, and copy it to all ``other`` splits."""
    own_splits, other_splits = (F.coalesce(F.col(c), F.lit(1)) for c in (own, other))
    return (
        side.withColumn("_hash", F.xxhash64("key", "_bucket"))
        .join(F.broadcast(splits), "_hash", "left")
        .withColumn(f"{own}_no", F.pmod(F.col("_spread"), own_splits))
        .withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0).cast("bigint"), other_splits - 1)))
        .drop("_hash", "_spread", own, other)
    )


def _tallied(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """The given columns of both sides, with a one under the side a row is from."""
    return left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )


def _splits(
    left: DataFrame, right: DataFrame, left_buckets: Column, right_buckets: Column, rows_per_task: int
) -> DataFrame:
    """How many ways each side of each hot ``(key, bucket)`` is split: ``(_hash, _left, _right)``.

    Only a hot key can have a hot bucket, so keys are counted first, which aggregates
    well before the shuffle, and buckets only for rows of hot keys; Spark drops that part
    at run time when there are none.

    When both sides are hot the group becomes a grid of about as many cells, so each side
    is cut into the square root of its own number of splits.
    """
    key_hash = F.xxhash64("key")
    hot_keys = hot_groups(_tallied(left, right, "key"), key_hash, rows_per_task).select("_hash")

    def of_hot_keys(side: DataFrame, buckets: Column) -> DataFrame:
        keyed = side.select("key", "ms", key_hash.alias("_hash"))
        return keyed.join(F.broadcast(hot_keys), "_hash").select("key", buckets.alias("_bucket"))

    hot = hot_groups(
        _tallied(of_hot_keys(left, left_buckets), of_hot_keys(right, right_buckets), "key", "_bucket"),
        F.xxhash64("key", "_bucket"),
        rows_per_task,
        {"_left": F.sum("_l"), "_right": F.sum("_r")},
    )
    counts = [F.col(c) for c in ("_left", "_right")]
    grid = all_of([c > rows_per_task for c in counts])

    def splits(rows_on_side: Column) -> Column:
        wanted = F.ceil(rows_on_side / rows_per_task)
        return F.greatest(F.when(grid, F.ceil(F.sqrt(wanted))).otherwise(wanted), F.lit(1)).cast("bigint")

    return hot.select("_hash", splits(counts[0]).alias("_left"), splits(counts[1]).alias("_right"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    window: int | timedelta,
    grace: int | timedelta = 0,
    join_type: str | None = "INNER",
    strict: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """All pairs with the same ``select_key`` text and timestamps at most ``window`` apart.

    Gives ``key, value{left_name{key, value}, right_name{key, value}}, ts`` with the later
    timestamp. A table has no late records, so ``grace`` is only checked.

    Time is cut into buckets, a right record goes into the one or two buckets it can match,
    and the equi-join runs on key and bucket, so a key with a long history is spread over
    many tasks. The right side is the one that is copied: put the smaller stream there. A
    bucket that is still too large is split by Spark's adaptive skew join, on one side or
    both, from the sizes of the shuffle. Where that is off, or one input task holds all of a
    bucket, ``rows_per_task`` splits by exact counts instead, for more reads of the keys.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    rules.batch("interval_join_stream", left, right)
    window_ms, _ = rules.join_window(window), rules.join_grace(grace)
    lefts, rights = (_interval_side(df, select_key, strict) for df in (left, right))
    return interval_pairs(lefts, rights, left_name, right_name, window_ms, rows_per_task)


def interval_pairs(
    lefts: DataFrame, rights: DataFrame, left_name: str, right_name: str, window_ms: int, rows_per_task: int | None = None
) -> DataFrame:
    """``interval_join`` over sides that are ready for it: ``key, record, ms, _spread``."""
    bucket_ms, ms = BUCKET_WINDOWS * window_ms, F.col("ms")
    at = _bucket(ms, bucket_ms)
    reach = F.explode(
        F.sequence(
            _bucket(ms - window_ms, bucket_ms), _bucket(ms + window_ms, bucket_ms), F.lit(bucket_ms).cast("bigint")
        )
    )
    l, r, keys = lefts.withColumn("_bucket", at), rights.withColumn("_bucket", reach), ["key", "_bucket"]
    if rows_per_task is not None:
        splits = _splits(lefts, rights, at, reach, rows_per_task)
        l = _with_split(l, splits, own="_left", other="_right")
        r = _with_split(r, splits, own="_right", other="_left")
        keys += ["_left_no", "_right_no"]
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys]
    near = F.abs(F.col("l.ms") - F.col("r.ms")) <= window_ms
    return l.alias("l").join(r.alias("r"), all_of([*same, near])).select(
        F.col("l.key").alias("key"),
        joined_value(left_name, F.col("l.record"), right_name, F.col("r.record")).alias("value"),
        F.timestamp_millis(F.greatest("l.ms", "r.ms")).alias("ts"),
    )


def latest_by_key(df: DataFrame, key: str = "key", order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Last record of each key by ``order``, which must be unique within a key.

    Spark keeps one row per key and task before it shuffles, so a hot key costs one row
    per task.
    """
    rules.required("order", list(order))
    rules.ordered(df, order)
    others = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return df.groupBy(key).agg(last).select(*[key if c == key else F.col(f"_last.{c}") for c in df.columns])


def _table_side(df: DataFrame, select_key: Column | str, strict: bool) -> DataFrame:
    rules.ordered(df, ARRIVAL)
    return df.select(
        as_text(df, select_key, strict).alias("key"), record().alias("record"), "ts", "partition", "offset"
    )


def table_join_latest(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    join_type: str | None = "INNER",
    strict: bool = True,
    order: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Final state of the table join: the latest left and right record of each key."""
    rules.join_sides(left_name, right_name, select_key, join_type)
    rules.batch("table_join_stream", left, right)
    l = latest_by_key(_table_side(left, select_key, strict), order=order).alias("l")
    r = latest_by_key(_table_side(right, select_key, strict), order=order).alias("r")
    return l.join(r, F.col("l.key") == F.col("r.key")).select(
        F.col("l.key").alias("key"),
        joined_value(left_name, F.col("l.record"), right_name, F.col("r.record")).alias("value"),
        F.greatest("l.ts", "r.ts").alias("ts"),
    )


def tagged_arrivals(left: DataFrame, right: DataFrame, select_key: Column | str, strict: bool) -> DataFrame:
    """Both sides as one set of arrivals: ``_left`` or ``_right`` holds the record, ``side`` is 0 or 1."""
    sides = []
    for side, (name, df) in enumerate((("_left", left), ("_right", right))):
        rows = _table_side(df, select_key, strict)
        held = F.struct("record", "ts")
        sides.append(rows.select("key", "ts", "partition", "offset", F.lit(side).alias("side"), held.alias(name)))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def table_join_changelog(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    join_type: str | None = "INNER",
    strict: bool = True,
    order_by: str = "ts",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every update of the table join: each arrival paired with the other side's latest record.

    Two topics have no common offset. ``order_by="ts"`` reads both sides in
    ``(ts, partition, offset, side)`` order, left before right on a tie;
    ``order_by="offset"`` is for sides that share one arrival sequence in
    ``(partition, offset)``. Rows carry the arrival's ``partition`` and a doubled
    ``offset`` that keeps both sides apart, so the changelog can feed another operator.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    rules.batch("table_join_stream", left, right)
    return paired_arrivals(tagged_arrivals(left, right, select_key, strict), left_name, right_name, order_by, rows_per_chunk)


def paired_arrivals(
    arrivals: DataFrame, left_name: str, right_name: str, order_by: str = "ts", rows_per_chunk: int = ROWS_PER_TASK
) -> DataFrame:
    """``table_join_changelog`` over ``tagged_arrivals`` that may come from a stored log of them."""
    rules.batch("table_join_stream", arrivals)
    order = pair_order(order_by)
    chunked = (with_hot_time_chunk if order_by == "ts" else with_hot_offset_chunk)(arrivals, ["key"], rows_per_chunk)
    return flat_pairs(running(chunked, ["key"], order, {"_left": "last", "_right": "last"}), left_name, right_name)


def pair_order(order_by: str) -> list[str]:
    """Columns of ``tagged_arrivals`` that say which record comes first."""
    if order_by not in ("ts", "offset"):
        raise ValueError(f"order_by must be 'ts' or 'offset', got {order_by!r}")
    return [*(["ts"] if order_by == "ts" else []), *ARRIVAL, "side"]


def flat_pairs(pairs: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Changelog rows of arrivals whose ``_left`` and ``_right`` are the latest records of both sides."""
    return pairs.where(F.col("_left").isNotNull() & F.col("_right").isNotNull()).select(
        "key",
        joined_value(left_name, F.col("_left.record"), right_name, F.col("_right.record")).alias("value"),
        F.greatest("_left.ts", "_right.ts").alias("ts"),
        "partition",
        (F.col("offset") * 2 + F.col("side")).alias("offset"),
    )
