"""Compaction of micro-batches leaves what readers give as it is."""

import os

from pyspark.sql import functions as F

from keyedflow.streaming.sinks import batch_folder, compact, read_cache_set, read_latest


def batches(folder):
    return sorted(int(f.removeprefix("batch_id=")) for f in os.listdir(folder) if f.startswith("batch_id="))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write(spark, folder, ids):
    writer = batch_folder(folder)
    for i in ids:
        # Keys come back in later micro-batches; by arrival some of these are older.
        ids = spark.range(10, numPartitions=1).select(((F.col("id") * 3 + i) % 17).cast("string").alias("key"), F.col("id") + 100 * i)
        named = ids.toDF("key", "value").withColumn("partition", F.lit(0)).withColumn("offset", (F.col("value") * 7919) % 100_003)
        writer(named, i)


def test_latest_and_set_after_compaction(spark, folder):
    orders = [("latest", ("batch_id",)), ("set", ("partition", "offset"))]
    read = {"latest": lambda f: read_latest(spark, f, ["key"]), "set": lambda f: read_cache_set(spark, f)}
    for name, order in orders:
        own = f"{folder}/{name}"
        write(spark, own, range(20))
        before = rows(read[name](own))
        compact(spark, own, 15, order=order)
        assert batches(own) == [15, 16, 17, 18, 19] and rows(read[name](own)) == before
        compact(spark, own, 15, order=order)  # as after one that was stopped
        compact(spark, own, 18, order=order)
        assert batches(own) == [18, 19] and rows(read[name](own)) == before
        write(spark, own, [20, 19])  # a new micro-batch, and one replayed
        write(spark, f"{folder}/{name}-all", range(21))
        assert rows(read[name](own)) == rows(read[name](f"{folder}/{name}-all"))
