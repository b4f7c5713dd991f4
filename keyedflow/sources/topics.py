"""Topic sources: Kafka, and folders of landed topic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from keyedflow import rules
from keyedflow.sources.envelope import decode

# Column names and types of a Kafka row in Spark, as a landed file keeps them.
LANDED_SCHEMA = "key STRING, value STRING, timestamp TIMESTAMP, partition INT, offset BIGINT"


# A micro-batch is bounded, and with it the rows one key can bring into a stateful task.
MAX_OFFSETS_PER_TRIGGER = 5_000_000
MAX_BYTES_PER_TRIGGER = 4 * 1024**3


def bounded_stream(spark: SparkSession, max_files_per_trigger: int | None = None) -> DataStreamReader:
    """Reader of a file stream, its micro-batches bounded by bytes unless a number of files is given."""
    if max_files_per_trigger is not None:
        return spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    return spark.readStream.option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER)


def kafka_options(topic: str, servers: str, streaming: bool, max_offsets_per_trigger: int) -> dict[str, str]:
    rules.required("topic", topic)
    rules.required("servers", servers)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if streaming:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_topic(
    spark: SparkSession,
    topic: str,
    servers: str,
    schema: T.StructType | str | None = None,
    streaming: bool = True,
    max_offsets_per_trigger: int = MAX_OFFSETS_PER_TRIGGER,
    **options: str,
) -> DataFrame:
    """Envelope stream (or batch) of a Kafka topic; needs Spark's Kafka connector package."""
    reader = spark.readStream if streaming else spark.read
    settings = kafka_options(topic, servers, streaming, max_offsets_per_trigger) | options
    return decode(reader.format("kafka").options(**settings).load(), schema)


def read_topic_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str | None = None,
    streaming: bool = False,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Envelope of topic rows landed as files with the columns of ``LANDED_SCHEMA``.

    Reading the arrival of a row that was written without one raises.
    """
    rules.required("folder", folder)
    reader = bounded_stream(spark, max_files_per_trigger) if streaming else spark.read
    landed = reader.format(file_format).schema(LANDED_SCHEMA).load(folder)
    message = F.lit("a landed row has no arrival; write join results with land()")
    arrival = {c: F.coalesce(F.col(c), F.raise_error(message).cast(landed.schema[c].dataType)) for c in ("partition", "offset")}
    return decode(landed.withColumns(arrival), schema)


def read_lookup(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Lookup table read over JDBC, for ``enrich_lookup``.

    ``query`` is the SELECT without its bound parameters; those become the ``on``
    pairs of the enrich. For a large table pass ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` with ``dbtable`` semantics so that it is read in parallel.
    """
    rules.required("url", url)
    rules.required("query", query)
    return spark.read.format("jdbc").options(**lookup_options(url, query), **options).load()


def lookup_options(url: str, query: str) -> dict[str, str]:
    # As a derived table rather than Spark's "query" option, which forbids partitioned reads.
    return {"url": url, "dbtable": f"({query}) lookup_rows"}
