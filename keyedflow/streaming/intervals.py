"""Interval join of two streams over stored records, for keys of any weight.

Records wait in files by bucket of time instead of a state store by key. A micro-batch is joined, as a
batch, with what waits within reach of its own times: its left records with all right ones, its right records with
the left ones that came before. Keys are spread by time bucket, and a bucket that is too large is
split by Spark's adaptive skew join or by exact counts, as in ``interval_join``; nothing is salted
ahead and no key has to fit a task.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow import rules
from keyedflow.operators.joins import interval_pairs, tagged_arrivals
from keyedflow.streaming.running import Step, step_stream

#: Length in join windows of the buckets that records wait in; a join reads up to one bucket too much.
WAITING_WINDOWS = 128


def _batches(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """Micro-batches below ``folder`` and the time buckets that each still has."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(at: str, kind: str) -> list[int]:
        names = [f.getPath().getName() for f in files.listStatus(path(at))] if files.exists(path(at)) else []
        return [int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=")]

    return {b: numbers(f"{folder}/batch_id={b}", "bucket") for b in numbers(folder, "batch_id")}


def _expire(spark: SparkSession, folder: str, held: dict[int, list[int]], oldest: int) -> dict[int, list[int]]:
    """Remove the buckets that start before ``oldest``; what is left."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, left = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for batch, buckets in held.items():
        left[batch] = [b for b in buckets if b >= oldest]
        for b in buckets if left[batch] else [None]:
            if b is None or b < oldest:
                files.delete(path(f"{folder}/batch_id={batch}" + ("" if b is None else f"/bucket={b}")), True)
    return left


def interval_step(
    folder: str, left_name: str, right_name: str, window: int | timedelta, grace: int | timedelta, rows_per_task: int | None = None,
    waiting_windows: int = WAITING_WINDOWS,
) -> Step:
    """Pairs that a batch of ``tagged_arrivals`` adds; ``folder`` keeps the records that may still find partners.

    Time buckets that ended more than a window and ``grace`` before the latest one of earlier batches go
    before a batch is joined, so a replay finds the same records.
    """
    window_ms, grace_ms = rules.join_window(window), rules.join_grace(grace)
    bucket_ms = waiting_windows * window_ms
    ms = F.unix_millis("ts")

    def side(rows: DataFrame, number: int, name: str) -> DataFrame:
        kept = rows.where(F.col("side") == number)
        return kept.select("key", F.col(f"{name}.record").alias("record"), ms.alias("ms"), F.xxhash64("partition", "offset").alias("_spread"))

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        held = {b: buckets for b, buckets in _batches(spark, folder).items() if b < batch_id}
        newest = max((b for buckets in held.values() for b in buckets), default=None)
        if newest is not None:
            held = _expire(spark, folder, held, newest - (window_ms + grace_ms) // bucket_ms * bucket_ms - bucket_ms)
        placed = batch.withColumn("bucket", ms - F.pmod(ms, F.lit(bucket_ms)))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch_id={batch_id}")
        new = [side(batch, n, name) for n, name in enumerate(("_left", "_right"))]
        first, last = batch.agg(F.min(ms), F.max(ms)).first()
        paths = [
            f"{folder}/batch_id={b}/bucket={k}"
            for b, buckets in held.items() for k in buckets
            if first is not None and first - window_ms < k + bucket_ms and k <= last + window_ms
        ]
        if not paths:
            return interval_pairs(*new, left_name, right_name, window_ms, rows_per_task)
        old = spark.read.schema(batch.schema).parquet(*paths)
        old = [side(old, n, name) for n, name in enumerate(("_left", "_right"))]
        return interval_pairs(new[0], new[1].unionByName(old[1]), left_name, right_name, window_ms, rows_per_task).unionByName(
            interval_pairs(old[0], new[1], left_name, right_name, window_ms, rows_per_task)
        )

    return step


def interval_join_changes_stream(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    window: int | timedelta,
    grace: int | timedelta,
    folder: str,
    checkpoint: str,
    join_type: str | None = "INNER",
    strict: bool = True,
    rows_per_task: int | None = None,
) -> DataStreamWriter:
    """``interval_join`` on two streams, each pair written in the micro-batch that completes it.

    Give a ``grace`` that covers how far records come out of time order; later ones may find
    their partners gone. Read the pairs with ``read_steps``.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    step = interval_step(f"{checkpoint}/tables/waiting", left_name, right_name, window, grace, rows_per_task)
    return step_stream(tagged_arrivals(left, right, select_key, strict), [step], folder, checkpoint)
