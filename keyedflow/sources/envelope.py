"""Building envelopes from tables and from raw topic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedflow import rules
from keyedflow.functions.exprs import resolved, to_column


def to_millis(df: DataFrame, expr: Column | str) -> Column:
    """Epoch ms of a timestamp, of a zone-less timestamp read as UTC, or of a number already in ms."""
    c, dtype = to_column(expr), resolved(df, expr).dataType
    if isinstance(dtype, T.TimestampNTZType):
        # Plain arithmetic: a cast to TIMESTAMP would apply the session time zone.
        since_epoch = c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.unix_millis(F.timestamp_micros(F.call_function("div", since_epoch, F.expr("INTERVAL '0.000001' SECOND"))))
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(c)
    return c.cast("bigint")


def stream_of(
    df: DataFrame,
    key: Column | str,
    value: Column | str,
    ts: Column | str,
    offset: Column | str,
    partition: Column | str | None = None,
) -> DataFrame:
    """Envelope of a table: expressions for key text, value, event time and arrival order.

    ``offset`` must be unique within ``partition`` (one partition, 0, by default).
    Event time is kept in whole milliseconds.
    """
    for name, arg in (("key", key), ("value", value), ("ts", ts), ("offset", offset)):
        rules.required(name, arg)
    return df.select(
        to_column(key).cast("string").alias("key"),
        to_column(value).alias("value"),
        F.timestamp_millis(to_millis(df, ts)).alias("ts"),
        (F.lit(0) if partition is None else to_column(partition).cast("int")).alias("partition"),
        to_column(offset).cast("bigint").alias("offset"),
    )


def decode(raw: DataFrame, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """Envelope of raw topic rows ``key, value, timestamp, partition, offset``.

    ``value`` is JSON text or bytes. With a ``schema`` it becomes a struct (which lets
    Spark prune fields), without one a VARIANT. A null value stays null. Malformed JSON
    raises, or gives null with ``strict=False``.
    """
    text = F.col("value").cast("string")
    if schema is not None:
        value = F.from_json(text, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    else:
        value = F.parse_json(text) if strict else F.try_parse_json(text)
    return raw.select(
        F.col("key").cast("string").alias("key"),
        value.alias("value"),
        F.timestamp_millis(to_millis(raw, "timestamp")).alias("ts"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
    )
