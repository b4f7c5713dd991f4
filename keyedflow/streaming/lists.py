"""Lists of a stream whose positions are made once, when the records arrive.

A table of counts per key gives each micro-batch the position at which it goes on, so readers number
nothing. Rows lie by bucket of their key: reading some keys opens their buckets only. Compaction
puts the rows of many micro-batches into one folder; positions stay what they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow.operators.joins import ARRIVAL
from keyedflow.operators.running import running, with_hot_offset_chunk
from keyedflow.operators.skew import ROWS_PER_TASK
from keyedflow.sinks.cache import cache_entries
from keyedflow.streaming.running import Step, merged, step_stream, with_held
from keyedflow.streaming.tables import BUCKETS, BucketTable

_MERGED = "merged_through"


def list_step(table: BucketTable, rows_per_chunk: int = ROWS_PER_TASK) -> Step:
    """``bucket, key, position, value`` of cache entries; ``table`` (keyed by key) keeps the lengths of the lists."""
    combine = {"position": lambda new, held: F.coalesce(new, F.lit(0)) + F.coalesce(held, F.lit(0))}

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        entries = batch.withColumn("position", F.lit(1).cast("bigint"))
        lengths = entries.groupBy("key").agg(F.sum("position").alias("position"))
        state = merged(table, batch.sparkSession, lengths, batch_id, combine)
        counted = running(with_hot_offset_chunk(entries, ["key"], rows_per_chunk), ["key"], ARRIVAL, {"position": "sum"})
        rows = with_held(counted, state, ["key"], combine).withColumn("position", F.col("position") - 1)
        return rows.select(table.bucket().alias("bucket"), "key", "position", "value")

    return step


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, but at most a task's worth of one list."""
    return rows.repartition("bucket", F.expr(f"position div {ROWS_PER_TASK}"))


def list_stream(
    df: DataFrame, key_expr: Column | str, folder: str, checkpoint: str, strict: bool = True,
    rows_per_chunk: int = ROWS_PER_TASK, buckets: int = BUCKETS,
) -> DataStreamWriter:
    """Streaming ``cache_list``: every value under its key and position; read it with ``read_list``."""
    step = list_step(BucketTable(f"{checkpoint}/tables/lengths", ["key"], buckets), rows_per_chunk)
    last = lambda batch, batch_id: _by_bucket(step(batch, batch_id))
    return step_stream(cache_entries(df, key_expr, strict), [last], folder, checkpoint, partition_by=["bucket"])


def _folders(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """Batches of the folder, and those through which finished compactions went."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName().partition("=") for f in files.listStatus(path(folder))]
    merges = [int(n) for kind, _, n in names if kind == _MERGED]
    return sorted(int(n) for kind, _, n in names if kind == "batch_id"), sorted(
        m for m in merges if files.exists(path(f"{folder}/{_MERGED}={m}/_SUCCESS"))
    )


def _rows(spark: SparkSession, folder: str, batches: Sequence[int], merges: Sequence[int]) -> DataFrame | None:
    """``bucket, key, position, value`` of the folders named."""
    parts = []
    if batches:
        parts.append(spark.read.option("basePath", folder).parquet(*[f"{folder}/batch_id={b}" for b in batches]).drop("batch_id"))
    parts += [spark.read.parquet(f"{folder}/{_MERGED}={m}") for m in merges]
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_list(spark: SparkSession, folder: str, keys: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``key, position, value`` of all lists, or of the lists of ``keys``, from their buckets alone."""
    batches, merges = _folders(spark, folder)
    through = merges[-1] if merges else -1
    rows = _rows(spark, folder, [b for b in batches if b > through], merges[-1:])
    if rows is None:
        raise ValueError(f"no batch has been written below {folder}")
    if keys is not None:
        asked = spark.createDataFrame([(k,) for k in keys], "key STRING")
        wanted = [r[0] for r in asked.select(BucketTable(folder, ["key"], buckets).bucket()).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(wanted) & F.col("key").isin(list(keys)))
    return rows.select("key", "position", "value")


def compact_list(spark: SparkSession, folder: str, through: int) -> None:
    """Put the batches up to ``through`` into one folder.

    ``through`` must be older than the stream's last micro-batch, which may be replayed. Readers take
    either the merged folder, once it is finished, or the batches, never both; a compaction that was stopped
    can be run again.
    """
    batches, merges = _folders(spark, folder)
    before = merges[-1] if merges else -1
    if through > before:
        rows = _rows(spark, folder, [b for b in batches if before < b <= through], merges[-1:])
        if rows is None:
            return
        _by_bucket(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{_MERGED}={through}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = max(before, through)
    for name in [f"batch_id={b}" for b in batches if b <= done] + [f"{_MERGED}={m}" for m in merges if m < done]:
        files.delete(path(f"{folder}/{name}"), True)
