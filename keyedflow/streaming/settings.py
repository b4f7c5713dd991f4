"""Session settings for streaming queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(
    spark: SparkSession,
    state_partitions: int | None = None,
    state_memory_mb: int | None = None,
    strict_lateness: bool = True,
) -> None:
    """Keep state in RocksDB and set its size; anything left None keeps Spark's default.

    ``state_partitions`` fixes the number of state stores of queries started later.
    ``state_memory_mb`` bounds RocksDB memory per executor. ``strict_lateness`` drops late
    rows as soon as the watermark passes them, for queries with one stateful operator.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if state_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", state_partitions)
    if state_memory_mb is not None:
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", state_memory_mb)
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", str(not strict_lateness).lower())


def trigger(commit_interval_ms: int | None = None) -> dict[str, str]:
    """Arguments for ``DataStreamWriter.trigger``; without an interval, all available data and stop."""
    return {"availableNow": True} if commit_interval_ms is None else {
        "processingTime": f"{commit_interval_ms} milliseconds"
    }
