"""Joins read their inputs once, and choose their strategy by size."""

import pytest
from pyspark.sql import functions as F

from keyedflow.operators import running
from keyedflow.operators.enrich import enrich_lookup
from keyedflow.operators.joins import interval_join
from keyedflow.plans import catalogue, tables
from keyedflow.plans.runs import read_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_customer(spark, sf_dir, orders, **options):
    customers = tables.table(spark, sf_dir, "customer")
    return enrich_lookup(orders, customers, [("value.customerId", "c_custkey")], [("c_name", "name")], **options)


def test_interval_join_reads_each_side_once(spark, sf_dir):
    e = tables.events(spark, sf_dir)
    assert plan(interval_join(e, e, "l", "r", "key", 600_000)).count("FileScan") == 2


def test_shuffled_lookup_reads_each_side_once(spark, sf_dir):
    shuffled = with_customer(spark, sf_dir, tables.orders(spark, sf_dir), broadcast_bytes=0)
    assert plan(shuffled).count("FileScan") == 2


@pytest.mark.parametrize("limit, broadcast", [("10m", True), ("1", False)])
def test_stream_lookup_is_broadcast_below_sparks_limit_only(spark, sf_dir, folder, capsys, limit, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        orders = tables.orders_envelope(read_stream(spark, sf_dir, "orders"))
        enriched = with_customer(spark, sf_dir, orders).select("key", "value.name")
        writer = enriched.writeStream.format("parquet").option("path", f"{folder}/out")
        started = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()
        started.explain()
        assert ("BroadcastHashJoin" in capsys.readouterr().out) == broadcast
        assert spark.read.parquet(f"{folder}/out").count() == tables.orders(spark, sf_dir).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


RUNNING = [
    ("aggregate_updates", 4), ("aggregate_updates_group_by", 4), ("cache_list_events", 4), ("table_join_updates", 4), ("table_join_interleaved", 4),
    ("late_drop_rows", 4), ("late_drop_updates", 6), ("job_customer_orders_stats", 6), ("updates_into_aggregate", 4),
]


@pytest.mark.parametrize("name, most", RUNNING)
def test_running_operators_plan_their_input_once(spark, sf_dir, monkeypatch, name, most):
    """Scans of what is run ahead to find hot keys, and of the plan itself, for each input."""
    ahead = []
    found = running._found
    monkeypatch.setattr(running, "_found", lambda groups: (ahead.append(plan(groups)), found(groups))[1])
    text = "".join([plan(catalogue.QUERIES[name](spark, sf_dir)), *ahead])
    inputs = 2 if name.startswith("table_join") or name == "updates_into_aggregate" else 1
    # Scans without columns only count the rows, for the fixture of shuffled events.
    assert text.count("FileScan") - text.count("ReadSchema: struct<>") <= most * inputs
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_constant_partition_needs_no_nested_loop(spark, folder):
    df = spark.range(500).select(F.lit("k").alias("key"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.timestamp_millis("id").alias("ts"))
    for chunked in (running.with_hot_offset_chunk(df, ["partition"], 20), running.with_hot_time_chunk(df, ["key"], 20)):
        assert "NestedLoop" not in plan(chunked) and chunked.where("_chunk is null").count() == 0
