"""Looking into the state of a streaming query, from its checkpoint folder.

The query need not be running, and reading does not disturb one that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedflow import rules


def list_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Stores of a query with the operator they belong to and their number of partitions."""
    rules.required("checkpoint", checkpoint)
    return (
        spark.read.format("state-metadata")
        .load(checkpoint)
        .select("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")
    )


def dump_state(
    spark: SparkSession,
    checkpoint: str,
    store: str = "default",
    operator_id: int = 0,
    partition: int | None = None,
    limit: int | None = None,
    batch_id: int | None = None,
    join_side: str | None = None,
) -> DataFrame:
    """Entries of a store: ``partition_id, key, value`` as JSON, with window bounds if it has any.

    ``join_side`` ("left" or "right") reads one side of a stream-stream join instead of a
    single named store.
    """
    rules.required("checkpoint", checkpoint)
    rules.required("store", store)
    reader = spark.read.format("statestore").option("operatorId", operator_id)
    reader = reader.option("joinSide", join_side) if join_side else reader.option("storeName", store)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    entries = reader.load(checkpoint)
    if partition is not None:
        entries = entries.where(F.col("partition_id") == partition)
    window = next((f.name for f in entries.schema["key"].dataType if _is_window(f.dataType)), None)
    bounds = []
    if window is not None:
        bounds = [
            F.unix_millis(F.col("key")[window][edge]).alias(name)
            for edge, name in (("start", "windowStart"), ("end", "windowEnd"))
        ]
    dump = entries.select("partition_id", _json(entries, "key"), *bounds, _json(entries, "value"))
    return dump if limit is None else dump.limit(limit)


def _json(entries: DataFrame, name: str) -> Column:
    """JSON of a state struct, field by field: join state rows hold more than their schema says.

    Aggregates may repeat a field name (two sums); later ones get their position appended.
    """
    dtype = entries.schema[name].dataType
    names = dtype.fieldNames()
    if len(set(names)) == len(names):
        whole = F.struct(*[F.col(name)[f].alias(f) for f in names])
    else:
        renamed = [
            T.StructField(f.name if f.name not in names[:i] else f"{f.name}_{i}", f.dataType)
            for i, f in enumerate(dtype)
        ]
        whole = F.col(name).cast(T.StructType(renamed))
    return F.to_json(whole, {"ignoreNullFields": "false"}).alias(name)


def _is_window(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.fieldNames() == ["start", "end"]
