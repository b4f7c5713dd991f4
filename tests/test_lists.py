"""Lists of a stream: positions made once, buckets read alone, compaction that can stop."""

import random

import pytest
from pyspark.sql import functions as F

from keyedflow.streaming import lists
from keyedflow.streaming.tables import BucketTable

from helpers import at

SCHEMA = "key STRING, value STRUCT<v: INT>, ts TIMESTAMP, partition INT, offset BIGINT"


@pytest.fixture
def landed(spark, folder):
    """A folder of lists that grew over nine micro-batches, and the lists."""
    rnd, rows, expected = random.Random(2), [], {}
    for i in range(450):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}"
        rows.append((key, (i,), at(i), 0, i))
        expected.setdefault(key, []).append(i)
    for i in range(9):
        spark.createDataFrame(rows[50 * i : 50 * i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        writer = lists.list_stream(stream, "key", f"{folder}/out", f"{folder}/c", rows_per_chunk=20 if i % 2 else 10**6, buckets=8)
        writer.trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out", expected


def read(spark, folder, keys=None):
    found = {}
    for r in lists.read_list(spark, folder, keys, 8).orderBy("key", "position").collect():
        assert r.position == len(found.setdefault(r.key, []))
        found[r.key].append(r.value.v)
    return found


def test_positions_buckets_and_compaction(spark, landed):
    folder, expected = landed
    assert read(spark, folder) == expected
    # One list comes from its bucket alone, without a window.
    one = lists.read_list(spark, folder, ["k3"], 8)
    plan = one._jdf.queryExecution().executedPlan().toString()
    bucket = spark.createDataFrame([("k3",)], "key STRING").select(BucketTable(folder, ["key"], 8).bucket()).first()[0]
    assert "Window" not in plan and "Exchange" not in plan and f"bucket#" in plan and f"[{bucket}]" in plan.replace("IN (", "[").replace(")", "]") or f"= {bucket}" in plan
    assert read(spark, folder, ["k3", "none"]) == {"k3": expected["k3"]}

    # A compaction that stopped before it was finished is not read, and can be run again.
    spark.range(3).write.parquet(f"{folder}/merged_through=5")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/merged_through=5/_SUCCESS"), False)
    assert read(spark, folder) == expected
    for through in (5, 5, 7):
        lists.compact_list(spark, folder, through)
        assert read(spark, folder) == expected and read(spark, folder, ["hot"]) == {"hot": expected["hot"]}
    assert lists._folders(spark, folder) == ([8], [7])


def test_nothing_written_yet(spark, folder):
    spark.range(1).write.parquet(f"{folder}/other")
    with pytest.raises(ValueError, match="no batch"):
        lists.read_list(spark, folder)
