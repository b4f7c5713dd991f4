"""Sinks that show a micro-batch together, and tables that keep their layout by key."""

import pytest
from pyspark.sql import functions as F

from keyedflow import Count, table_join_latest, window_aggregate
from keyedflow.plans.catalogue import colocated_orders
from keyedflow.sinks.topics import write_colocated
from keyedflow.streaming.sinks import batch_folder, fan_out, last_commit, read_committed


def test_a_failure_between_two_sinks_shows_the_batch_in_neither(spark, folder):
    first, second, commits = (f"{folder}/{n}" for n in ("first", "second", "commits"))

    def run(fail: bool) -> None:
        def broken(batch, batch_id):
            if fail:
                raise RuntimeError("the second sink is away")
            batch_folder(second)(batch.select((F.col("id") * 2).alias("id")), batch_id)

        stream = spark.readStream.schema("id BIGINT").parquet(f"{folder}/in")
        fan_out(stream, [batch_folder(first), broken], f"{folder}/c", commits).trigger(availableNow=True).start().awaitTermination()

    def shown() -> tuple:
        return tuple(sorted(r.id for r in read_committed(spark, f, commits).collect()) for f in (first, second))

    assert last_commit(spark, commits) is None
    with pytest.raises(ValueError, match="committed"):
        read_committed(spark, first, commits)
    spark.range(3).write.mode("append").parquet(f"{folder}/in")
    run(False)
    assert shown() == ([0, 1, 2], [0, 2, 4]) and last_commit(spark, commits) == 0
    spark.range(5, 7).write.mode("append").parquet(f"{folder}/in")
    with pytest.raises(Exception, match="second sink is away"):
        run(True)
    assert spark.read.parquet(first).count() == 5 and shown() == ([0, 1, 2], [0, 2, 4])
    run(False)
    assert shown() == ([0, 1, 2, 5, 6], [0, 2, 4, 10, 12]) and last_commit(spark, commits) == 1


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_colocated_tables_are_joined_and_aggregated_without_a_shuffle(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        customers, orders = colocated_orders(spark, sf_dir)
        joined = table_join_latest(customers, orders, "customer", "order", "key", strict=False)
        stats = window_aggregate(orders, [Count("n")], 60_000, strict=False)
        assert exchanges(joined) == exchanges(stats) == 0
        assert joined.count() == orders.select("key").distinct().count() and exchanges(orders.groupBy("offset").count()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_colocated_rules(spark, folder):
    with pytest.raises(ValueError, match="buckets"):
        write_colocated(spark.range(1).withColumn("key", F.lit("a")), "t", folder, 0)
    with pytest.raises(ValueError, match="folder"):
        write_colocated(spark.range(1), "t", " ", 2)
