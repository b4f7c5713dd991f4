import random

import pytest
from helpers import envelope, records
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyedflow import (
    cache_list,
    cache_set,
    enrich_lookup,
    filter_,
    interval_join,
    latest_by_key,
    path,
    read_topic_files,
    table_join_latest,
    template,
)
from keyedflow.sinks.cache import cache_sink
from keyedflow.sinks.topics import land, write_topic_files
from keyedflow.sources.topics import kafka_options, lookup_options

LOOKUP = "id INT, region STRING, name STRING, score DOUBLE, rank INT"


def lookup(spark):
    rows = [(1, "eu", "one", 1.5, 1), (2, "eu", "two-b", 2.5, 2), (2, "eu", "two-a", 7.5, 1), (3, "us", None, 3.0, 1), (None, "eu", "none", 0.0, 0)]
    return spark.createDataFrame(rows, LOOKUP)


def enriched(spark, values, fields, schema=None, key=None, **options):
    e = envelope(spark, [(f"k{i}", v, i) for i, v in enumerate(values)], schema)
    on = [(path("id") if schema is None else "value.id", "id")] if key is None else key
    return [v for _, v, _ in records(enrich_lookup(e, lookup(spark), on, fields, **options), "key")]


SMALL_AND_LARGE = pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 1}])


@SMALL_AND_LARGE
@pytest.mark.parametrize("schema", [None, "id INT, old STRING"])
def test_hit_miss_and_first_row(spark, schema, options):
    values = [{"id": 1, "old": "a"}, {"id": 2, "old": "b"}, {"id": 9, "old": "c"}, {"id": 3, "old": "d"}]
    got = enriched(spark, values, [("name", "name"), ("score", "old")], schema, order_by=["rank"], **options)
    assert got == [
        {"id": 1, "name": "one", "old": "1.5"},
        {"id": 2, "name": "two-a", "old": "7.5"},
        {"id": 9, "name": None, "old": None},
        {"id": 3, "name": None, "old": "3.0"},
    ]


@SMALL_AND_LARGE
def test_several_parameters(spark, options):
    key = [(path("id"), "id"), (path("where"), "region")]
    got = enriched(spark, [{"id": 1, "where": "eu"}, {"id": 1, "where": "us"}], [("name", "n")], key=key, **options)
    assert [v["n"] for v in got] == ["one", None]


def test_no_parameters_takes_the_first_row_for_all(spark):
    got = enriched(spark, [{"id": 1}, {"id": 9}], [("name", "n")], key=[], order_by=["rank", "id"])
    assert [v["n"] for v in got] == ["none", "none"]


def test_without_an_order_the_choice_is_still_fixed(spark):
    assert enriched(spark, [{"id": 2}], [("name", "n")])[0]["n"] == "two-a"


def test_missing_parameter_and_null_value_raise(spark):
    for value in ({"x": 1}, None):
        with pytest.raises(PySparkException, match="null"):
            enriched(spark, [value], [("name", "n")])


def test_hot_lookup_key_is_split(spark):
    values = [{"id": 1}] * 50 + [{"id": 3}] * 2 + [{"id": 9}] * 30
    got = enriched(spark, values, [("score", "s")], broadcast_bytes=0, rows_per_task=4)
    assert sorted(map(str, [v["s"] for v in got])) == ["1.5"] * 50 + ["3.0"] * 2 + ["None"] * 30


def test_cache_set_last_write_wins(spark):
    e = envelope(spark, [("a", {"id": 1, "v": 1}, 9), ("b", {"id": 1, "v": 2}, 0), ("c", {"id": 2, "v": 3}, 0)])
    got = cache_set(e, template(e, "user:@{variant_get(value, '$.id', 'string')}"))
    assert sorted((r.key, r.v) for r in got.select("key", F.to_json("value").alias("v")).collect()) == [
        ("user:1", '{"id":1,"v":2}'),
        ("user:2", '{"id":2,"v":3}'),
    ]


def positions(df):
    rows = df.select("key", "position", F.variant_get("value", "$.v", "int").alias("v")).collect()
    return sorted((r.key, r.position, r.v) for r in rows)


@pytest.mark.parametrize("rows_per_chunk", [1, 3, 1_000_000])
def test_cache_list_keeps_arrival_order_and_duplicates(spark, rows_per_chunk):
    rng = random.Random(rows_per_chunk)
    rows = [(rng.choice("aab"), rng.randrange(3), i, p) for p in range(2) for i in range(30)]
    e = envelope(spark, [(k, {"v": v}, 0, offset, p) for k, v, offset, p in rows])
    want = [(k, i, v) for k in "ab" for i, v in enumerate([v for key, v, _, _ in rows if key == k])]
    assert positions(cache_list(e, "key", rows_per_chunk=rows_per_chunk)) == sorted(want)


def test_cache_sink_modes_and_null_value(spark):
    e = envelope(spark, [("a", {"v": 1}, 0), ("a", {"v": 2}, 0)])
    assert cache_sink(e, "key", "SET").count() == 1
    assert positions(cache_sink(e, "key", "LIST_APPEND")) == [("a", 0, 1), ("a", 1, 2)]
    for mode in ("SET", "LIST_APPEND"):
        with pytest.raises(PySparkException, match="null value"):
            cache_sink(envelope(spark, [("a", None, 0)]), "key", mode).collect()


def test_topic_files_round_trip(spark, folder):
    rows = [("a", {"x": 1, "n": None}, 5, 0), ("b", None, 6, 1)]
    for file_format in ("parquet", "json"):
        write_topic_files(envelope(spark, rows), f"{folder}/{file_format}", file_format)
        back = read_topic_files(spark, f"{folder}/{file_format}", file_format=file_format)
        assert records(back, "offset") == [("a", {"x": 1, "n": None}, 5), ("b", None, 6)]


def test_landed_order(spark, folder):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), {"v": rng.randrange(3)}, rng.choice([7, 7, 7, rng.randrange(50)])) for _ in range(200)]
    land(envelope(spark, rows).select("key", "value", "ts"), folder, partitions=4)
    back = read_topic_files(spark, folder)
    assert back.select("partition", "offset").distinct().count() == 200
    assert back.select("partition").distinct().count() > 1
    got = [(ms, key, v["v"]) for key, v, ms in records(back, "partition", "offset")]
    assert got == sorted((ms, key, v["v"]) for key, v, ms in rows)
    per_partition = {}
    for r in back.select("partition", "offset").collect():
        per_partition.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(offsets) == list(range(len(offsets))) for offsets in per_partition.values())


def test_join_results_feed_joins_and_enrichment_but_need_landing_for_order(spark, folder):
    e = envelope(spark, [("K", {"id": 1}, i) for i in range(3)])
    pairs = interval_join(e, e, "a", "b", "key", 1)
    assert interval_join(pairs, e, "p", "e", "key", 10, rows_per_task=2).count() == 7 * 3
    on = [(F.variant_get("value.a.value", "$.id", "string"), "id")]
    again = enrich_lookup(pairs, lookup(spark), on, [("name", "n")], broadcast_bytes=0, rows_per_task=2)
    assert [r.n for r in again.select("value.n").collect()] == ["one"] * 7
    for ordered in (lambda: cache_set(pairs, "key"), lambda: latest_by_key(pairs), lambda: table_join_latest(pairs, e, "a", "b", "key")):
        with pytest.raises(ValueError, match="land"):
            ordered()
    land(pairs, folder, 2)
    assert cache_list(read_topic_files(spark, folder), "key").count() == 7


def test_cache_set_by_another_order(spark):
    e = envelope(spark, [("a", {"v": 1}, 9), ("a", {"v": 2}, 3)])
    got = cache_set(e, "key", order=("ts", "partition", "offset"))
    assert got.select(F.to_json("value")).first()[0] == '{"v":1}'


def test_connector_options():
    assert kafka_options("t", "h:1", True, 10) == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": "10",
    }
    assert "maxOffsetsPerTrigger" not in kafka_options("t", "h:1", False, 10)
    assert lookup_options("jdbc:x", "SELECT 1 AS a") == {"url": "jdbc:x", "dbtable": "(SELECT 1 AS a) lookup_rows"}


def test_strict_filter_reaches_the_scan(spark, folder):
    spark.range(10).selectExpr("cast(id as string) as key", "named_struct('n', id) as value").write.parquet(f"{folder}/t")
    kept = filter_(spark.read.parquet(f"{folder}/t"), "value.n > 3")
    assert "GreaterThan(value.n,3)" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 6
    spark.range(2).selectExpr("cast(id as string) as key", "named_struct('n', nullif(id, 1)) as value").write.parquet(f"{folder}/u")
    with pytest.raises(Exception, match="null"):
        filter_(spark.read.parquet(f"{folder}/u"), "value.n > 3").collect()


def test_cache_set_by_an_order_of_its_own(spark):
    totals = spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("a", 2, 6), ("b", 1, 1)], "key string, ts int, value int")
    assert {tuple(r) for r in cache_set(totals, "key", order=["ts"]).collect()} == {("a", 7), ("b", 1)}


def test_land_refuses_a_folder_that_has_rows(spark, folder):
    rows = envelope(spark, [("a", {"n": 1}, 5)], "n BIGINT").select("key", "value", "ts")
    land(rows, f"{folder}/t")
    with pytest.raises(ValueError, match="has rows"):
        land(rows, f"{folder}/t")


def test_rows_landed_without_arrival_raise(spark, folder):
    rows = envelope(spark, [("a", {"n": 1}, 5)], "n BIGINT").select("key", "value", "ts")
    write_topic_files(rows, f"{folder}/t")
    with pytest.raises(Exception, match="no arrival"):
        cache_list(read_topic_files(spark, f"{folder}/t", "n BIGINT"), "key").collect()
