"""Topic sinks: JSON encoding and writing to Kafka or to landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow import rules


def encode(df: DataFrame) -> DataFrame:
    """Topic rows of an envelope: ``value`` becomes JSON text that keeps nulls inside objects.

    A null value stays null (a tombstone).
    """
    json = F.to_json("value", {"ignoreNullFields": "false"})
    names = {"ts": "timestamp"}
    rest = [F.col(c).alias(names.get(c, c)) for c in df.columns if c not in ("key", "value")]
    return df.select("key", json.alias("value"), *rest)


def write_topic(df: DataFrame, topic: str, servers: str, **options: str) -> None:
    """Append a batch envelope to a Kafka topic; the broker stamps the time."""
    rules.required("topic", topic)
    encoded = encode(df).select("key", "value")
    encoded.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(
        **options
    ).save()


def write_topic_files(df: DataFrame, folder: str, file_format: str = "parquet") -> None:
    """Append a batch envelope to a folder of landed topic rows."""
    rules.required("folder", folder)
    encode(df).write.format(file_format).mode("append").save(folder)


def _has_rows(spark: SparkSession, folder: str) -> bool:
    try:
        return not spark.read.schema("offset BIGINT").parquet(folder).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def land(
    df: DataFrame, folder: str, partitions: int | None = None, order: Sequence[str] = ("ts", "key")
) -> None:
    """Give a derived envelope an arrival order by writing it as a topic.

    Join results have no ``partition`` and ``offset`` of their own. This writes them sorted
    by ``order`` (ties by value), cut into ranges of about equal size that become the
    partitions, so that ``(partition, offset)`` follows the order over the whole topic. Read
    it back with ``read_topic_files``, which also saves computing a long chain twice.

    The partitions are as many as the session shuffles to, if not given. A folder that has
    rows is refused: offsets start at 0, so a second run would repeat those of the first.
    """
    rules.required("folder", folder)
    if _has_rows(df.sparkSession, folder):
        raise ValueError(f"{folder} has rows already; their offsets would be repeated")
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions <= 0:
        raise ValueError(f"partitions must be above 0, got {partitions}")
    by = [*["timestamp" if c == "ts" else c for c in order], "value"]
    ranges = encode(df.select("key", "value", "ts")).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    partition = F.spark_partition_id()
    # The id counts up within a partition and holds the partition in its upper 31 bits.
    offset = F.monotonically_increasing_id() - F.shiftleft(partition.cast("bigint"), 33)
    ranges.select("*", partition.alias("partition"), offset.alias("offset")).write.mode("append").parquet(folder)


def topic_stream(df: DataFrame, topic: str, servers: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a streaming envelope to a Kafka topic; call ``start()`` on it."""
    rules.required("topic", topic)
    return (
        encode(df)
        .select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def topic_files_stream(df: DataFrame, folder: str, checkpoint: str, file_format: str = "parquet") -> DataStreamWriter:
    """Writer of a streaming envelope to a folder of landed topic rows; call ``start()`` on it."""
    rules.required("folder", folder)
    return (
        encode(df)
        .writeStream.format(file_format)
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def write_colocated(df: DataFrame, table: str, folder: str, buckets: int) -> None:
    """Keep an envelope below ``folder`` as a table of the catalog, its rows in ``buckets`` by key.

    Tables written with the same number of buckets are joined and aggregated by ``key`` where they lie,
    without a shuffle, every time they are read; make ``key`` what they are joined by with ``rekey``
    first. Choose buckets so that the rows of one fit a task. A hot key lies in one bucket: Spark can't
    split it there, so leave data with such keys as topics.
    """
    rules.required("table", table)
    rules.required("folder", folder)
    if buckets < 1:
        raise ValueError(f"buckets must be at least 1, got {buckets}")
    rules.batch("topic_files_stream", df)
    # Rows of a bucket in one task, so that each bucket is one file.
    placed = df.repartition(buckets, "key")
    placed.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").option("path", folder).saveAsTable(table)


def read_colocated(spark: SparkSession, table: str) -> DataFrame:
    """The envelope of ``write_colocated``. Operators keep its layout with ``strict=False``, as a check of the
    key makes another column of it; all keys were checked when the table was written.
    """
    rules.required("table", table)
    return spark.table(table)
