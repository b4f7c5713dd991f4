"""Envelopes over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedflow.sources.envelope import stream_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by user, in ``event_id`` order."""
    return events_envelope(table(spark, sf_dir, "events"))


def events_envelope(df: DataFrame) -> DataFrame:
    return stream_of(df, "user_id", F.struct("event_type", "value", "props"), "ts", "event_id")


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is the JSON of ``props`` as VARIANT."""
    return stream_of(table(spark, sf_dir, "events"), "user_id", F.parse_json("props"), "ts", "event_id")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a changelog topic: no event time of their own, so all at the epoch."""
    return customers_envelope(table(spark, sf_dir, "customer"))


def customers_envelope(df: DataFrame) -> DataFrame:
    value = F.struct(
        F.col("c_custkey").cast("string").alias("customerId"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    return stream_of(df, "c_custkey", value, F.lit(0).cast("bigint"), "c_custkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders keyed by order number, in that order."""
    return orders_envelope(table(spark, sf_dir, "orders"))


def orders_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that arrive day by day, and by number within a day."""
    day = F.expr("unix_millis(ts) div 86400000")
    return orders(spark, sf_dir).withColumn("offset", F.shiftleft(day, 44) + F.col("value.orderId"))


def orders_envelope(df: DataFrame) -> DataFrame:
    value = F.struct(
        F.col("o_custkey").cast("string").alias("customerId"),
        F.col("o_orderkey").alias("orderId"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return stream_of(df, "o_orderkey", value, "o_orderdate", "o_orderkey")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns keyed by conversation; each conversation is one ordered source."""
    df = table(spark, sf_dir, "conversations")
    value = F.struct("role", "text")
    return stream_of(df, "conv_id", value, F.lit(0).cast("bigint"), "turn", partition="conv_id")
