"""Chunks follow the number of rows, whatever gaps and bursts the positions have."""

import pytest
from pyspark.sql import functions as F

from keyedflow.operators.running import with_hot_offset_chunk, with_hot_time_chunk

ROWS, PER_CHUNK = 2_000, 50


def sizes(df):
    return [r["count"] for r in df.groupBy("_chunk").count().collect()]


def frame(spark, offset="id", ms="id"):
    df = spark.range(ROWS).select(F.lit("K").alias("key"), F.lit(0).alias("partition"), F.expr(offset).cast("bigint").alias("offset"), F.timestamp_millis(F.expr(ms).cast("bigint")).alias("ts"))
    return df.unionByName(df.limit(1).withColumn("key", F.lit("small")))


@pytest.mark.parametrize("offset", ["id", "id * 1000000", "id + 1000000 * (id div 1000)", "if(id = 0, -1000000000000, id)"])
def test_chunks_by_offset(spark, offset):
    got = sizes(with_hot_offset_chunk(frame(spark, offset), ["key"], PER_CHUNK))
    assert max(got) <= PER_CHUNK and len(got) <= 5 * ROWS / PER_CHUNK


@pytest.mark.parametrize("ms", ["id", "id * 1000000", "0", "if(id = 0, 1000000000000, id)", "id div 700"])
def test_chunks_by_time(spark, ms):
    got = sizes(with_hot_time_chunk(frame(spark, ms=ms), ["key"], PER_CHUNK))
    assert max(got) <= PER_CHUNK and len(got) <= 5 * ROWS / PER_CHUNK


def test_chunks_keep_the_order_and_leave_small_keys_whole(spark):
    by_offset = with_hot_offset_chunk(frame(spark, "id * 999 + 7"), ["key"], PER_CHUNK)
    by_time = with_hot_time_chunk(frame(spark, ms="if(id < 1500, 5, id)"), ["key"], PER_CHUNK)
    for df, order in ((by_offset, ["partition", "offset"]), (by_time, ["ts", "partition", "offset"])):
        assert df.where("_chunk is null").select("key").collect() == [("small",)]
        ends = df.where("key = 'K'").groupBy("_chunk").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        rows = ends.orderBy("_chunk").collect()
        assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
