"""Streaming sinks that stay correct when a micro-batch is replayed.

Each micro-batch is written to its own ``batch_id=N`` folder, overwriting what an
earlier attempt left there. Nothing written before is read or rewritten, so a batch costs
only its own rows; readers merge on the way in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow import rules
from keyedflow.operators.joins import ARRIVAL, latest_by_key
from keyedflow.operators.running import running, with_hot_offset_chunk
from keyedflow.operators.skew import ROWS_PER_TASK
from keyedflow.sinks.cache import MODES, cache_entries

BatchWriter = Callable[[DataFrame, int], None]


def batch_folder(folder: str) -> BatchWriter:
    """Writer of one micro-batch to its own folder below ``folder``."""
    rules.required("folder", folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def fan_out(df: DataFrame, sinks: Sequence[BatchWriter], checkpoint: str, commits: str | None = None) -> DataStreamWriter:
    """Write each micro-batch to several sinks, computing it once; call ``start()`` on the result.

    With a folder ``commits``, a batch counts only when all sinks have it: ``read_committed`` shows either
    all of its rows in every sink or none in any. A batch that failed between two sinks is replayed and
    overwrites what it left.
    """
    rules.required("sinks", list(sinks))

    def write_all(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
            if commits is not None:
                _commit(batch.sparkSession, commits, batch_id)
        finally:
            batch.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_all)


def _listed(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, its paths, and the names in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    at = path(folder)
    return files, path, [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def _commit(spark: SparkSession, commits: str, batch_id: int) -> None:
    # Micro-batches follow each other, so the last name says it all; it is there before older ones go.
    files, path, names = _listed(spark, commits)
    files.create(path(f"{commits}/{batch_id}"), True).close()
    for name in names:
        if name.isdigit() and int(name) < batch_id:
            files.delete(path(f"{commits}/{name}"), False)


def last_commit(spark: SparkSession, commits: str) -> int | None:
    """The last micro-batch that all sinks of a ``fan_out`` have."""
    return max((int(n) for n in _listed(spark, commits)[2] if n.isdigit()), default=None)


def read_committed(spark: SparkSession, folder: str, commits: str) -> DataFrame:
    """Rows of a ``batch_folder`` up to the last micro-batch that all sinks have."""
    last = last_commit(spark, commits)
    names = [n for n in _listed(spark, folder)[2] if n.startswith("batch_id=")]
    kept = [f"{folder}/{n}" for n in names if last is not None and int(n.partition("=")[2]) <= last]
    if not kept:
        raise ValueError(f"no batch of {folder} has been committed")
    return spark.read.option("basePath", folder).parquet(*kept).drop("batch_id")


def append_stream(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Append an envelope to a parquet folder as it is, values typed."""
    rules.required("folder", folder)
    writer = df.writeStream.format("parquet").option("path", folder)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def upsert_stream(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Keep an update-mode stream as a table of changed rows; read it with ``read_latest``."""
    return (
        df.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("update")
        .foreachBatch(batch_folder(folder))
    )


def read_latest(spark: SparkSession, folder: str, keys: Sequence[Column | str]) -> DataFrame:
    """Newest row of each key in an ``upsert_stream`` folder; a batch holds a key at most once."""
    rows = spark.read.parquet(folder).withColumn("_key", F.struct(*keys))
    return latest_by_key(rows, "_key", ["batch_id"]).drop("_key", "batch_id")


def compact(
    spark: SparkSession, folder: str, through: int, keys: Sequence[Column | str] = ("key",), order: Sequence[str] = ("batch_id",)
) -> None:
    """Merge the micro-batches up to ``through`` into that one: the newest row of each key.

    For the folders of ``upsert_stream`` (name the ``keys`` that ``read_latest`` is given) and of
    SET caches (name the ``order`` that ``read_cache_set`` is given); a list keeps every row.
    ``through`` must be older than the stream's last micro-batch, which may be replayed. Merged
    rows are added before older folders go, and a row that is there twice changes nothing for
    these readers, so a compaction that was stopped can be run again. Readers that have
    listed the folder before may miss files and must read again.
    """
    rows = spark.read.parquet(folder).where(F.col("batch_id") <= through).withColumn("_key", F.struct(*keys))
    newest = latest_by_key(rows, "_key", order).drop("_key", "batch_id")
    newest.write.mode("append").parquet(f"{folder}/batch_id={through}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):
        kind, _, batch_id = found.getPath().getName().partition("=")
        if kind == "batch_id" and int(batch_id) < through:
            files.delete(found.getPath(), True)


def cache_stream(
    df: DataFrame,
    key_expr: Column | str,
    folder: str,
    checkpoint: str,
    mode: str | None = "SET",
    strict: bool = True,
    order: Sequence[str] = ARRIVAL,
    output_mode: str = "append",
) -> DataStreamWriter:
    """Streaming ``cache_sink``; read the result with ``read_cache_set`` or ``read_cache_list``.

    Totals and join results have no arrival of their own. A SET cache takes another ``order``,
    such as ``["ts"]`` for totals in update mode; a list needs the arrival that ``land`` gives.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if mode == "LIST_APPEND" and tuple(order) != ARRIVAL:
        raise ValueError("a list is kept in arrival order; write join results with land() to get one")
    write, entries = batch_folder(folder), cache_entries(df, key_expr, strict, order)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write(latest_by_key(batch, order=order) if mode == "SET" else batch, batch_id)

    return entries.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).foreachBatch(write_batch)


def read_cache_set(spark: SparkSession, folder: str, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """``key, value`` of a SET cache: the newest by ``order``, which must tell the records of a key apart.

    By arrival the result doesn't depend on micro-batches. For totals in update mode name
    ``batch_id`` first: a later micro-batch replaces what an earlier one wrote.
    """
    return latest_by_key(spark.read.parquet(folder), order=order).select("key", "value")


def read_cache_list(spark: SparkSession, folder: str, rows_per_chunk: int = ROWS_PER_TASK) -> DataFrame:
    """``key, position, value`` of a LIST_APPEND cache, in arrival order whatever the micro-batches."""
    rows = spark.read.parquet(folder).drop("batch_id")
    entries = with_hot_offset_chunk(rows.withColumn("position", F.lit(1).cast("bigint")), ["key"], rows_per_chunk)
    counted = running(entries, ["key"], ARRIVAL, {"position": "sum"})
    return counted.select("key", (F.col("position") - 1).alias("position"), "value")
