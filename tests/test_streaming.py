"""Streaming forms against their batch forms, over several micro-batches."""

import json
import random

import pytest
from helpers import raw, records
from pyspark.sql import functions as F

from keyedflow import (
    Count,
    Sum,
    cache_list,
    cache_set,
    decode,
    enrich_lookup,
    filter_,
    interval_join,
    mapping,
    merge,
    path,
    read_topic_files,
    rekey,
    table_join_changelog,
    window_aggregate,
)
from keyedflow.operators.transforms import FROM_KEY
from keyedflow.plans.runs import run_to_end, work_folder
from keyedflow.sinks.topics import topic_files_stream
from keyedflow.streaming.aggregates import window_aggregate_stream
from keyedflow.streaming.joins import interval_join_stream, table_join_stream
from keyedflow.streaming.settings import configure, trigger
from keyedflow.streaming.sinks import (
    batch_folder,
    cache_stream,
    fan_out,
    read_cache_list,
    read_cache_set,
    read_latest,
    upsert_stream,
)
from keyedflow.streaming.state import dump_state, list_state

ID, MINUTE = path("id"), 60_000


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


class Topic:
    """A folder of topic rows that grows by one file per ``land``; one file is one micro-batch."""

    def __init__(self, spark, folder, name, schema=None):
        self.spark, self.folder, self.schema = spark, f"{folder}/{name}", schema
        self.rows = []

    def land(self, *rows):
        """Rows of ``(key, value, ms)``; offsets go on from the last file."""
        rows = [(k, v, ms, len(self.rows) + i) for i, (k, v, ms) in enumerate(rows)]
        raw(self.spark, rows).coalesce(1).write.mode("append").parquet(self.folder)
        self.rows += rows
        return self

    def stream(self):
        return read_topic_files(self.spark, self.folder, self.schema, streaming=True, max_files_per_trigger=1)

    def table(self):
        return decode(raw(self.spark, self.rows), self.schema)


def topic(spark, folder, name, *files, schema=None):
    t = Topic(spark, folder, name, schema)
    for f in files:
        t.land(*f)
    return t


def landed(spark, df, folder):
    """Run a stream into a topic folder and read it back as ``(key, value, ms)``."""
    run_to_end(topic_files_stream(df, f"{folder}/out", f"{folder}/checkpoint"))
    rows = spark.read.parquet(f"{folder}/out").select("key", "value", F.unix_millis("timestamp").alias("ms"))
    return sorted((r.key, r.value, r.ms) for r in rows.collect())


def as_json(rows):
    return sorted((k, json.dumps(v, separators=(",", ":")), ms) for k, v, ms in rows)


def same_objects(got, want):
    assert [(k, json.loads(v), ms) for k, v, ms in got] == [(k, json.loads(v), ms) for k, v, ms in sorted(want)]


@pytest.mark.parametrize("salts", [1, 3])
def test_interval_join_equals_batch(spark, folder, salts):
    rng = random.Random(salts)

    def files(tag):
        return [
            [(f"{tag}{b}-{i}", {"id": rng.choice("hhhab"), "v": f"{tag}{b}-{i}"}, 10_000 * b + rng.randrange(10_000)) for i in range(8)]
            for b in range(3)
        ]

    left, right = topic(spark, folder, "l", *files("L")), topic(spark, folder, "r", *files("R"))
    args = ("left", "right", ID, 5_000, 30_000)
    got = landed(spark, interval_join_stream(left.stream(), right.stream(), *args, salts=salts), folder)
    same_objects(got, as_json(records(interval_join(left.table(), right.table(), *args))))


@pytest.mark.parametrize("shift,rows", [(5000, 1), (-5000, 1), (5001, 0), (-5001, 0)])
def test_interval_join_bounds(spark, folder, shift, rows):
    left = topic(spark, folder, "l", [("a", {"id": "K"}, 100_000)])
    right = topic(spark, folder, "r", [("b", {"id": "K"}, 100_000 + shift)])
    pairs = interval_join_stream(left.stream(), right.stream(), "left", "right", ID, 5_000, 0)
    assert len(landed(spark, pairs, folder)) == rows


@pytest.mark.parametrize("schema", [None, "id STRING, v STRING"])
def test_table_join_keeps_state_between_batches(spark, folder, schema):
    key = ID if schema is None else "value.id"
    left = topic(spark, folder, "l", [("lk", {"id": "K", "v": "A1"}, 0)], schema=schema)
    right = topic(spark, folder, "r", [("rk", {"id": "K", "v": "B1"}, 1)], schema=schema)

    def run():
        pairs = table_join_stream(left.stream(), right.stream(), "left", "right", key)
        return [
            (json.loads(v)["left"]["value"]["v"], json.loads(v)["right"]["value"]["v"], ms)
            for _, v, ms in sorted(landed(spark, pairs, folder), key=lambda r: r[2])
        ]

    assert run() == [("A1", "B1", 1)]
    left.land(("lk", {"id": "K", "v": "A2"}, 2), ("x", {"id": "other", "v": "-"}, 2))
    assert run() == [("A1", "B1", 1), ("A2", "B1", 2)]
    right.land(("rk", {"id": "K", "v": "B2"}, 3))
    assert run() == [("A1", "B1", 1), ("A2", "B1", 2), ("A2", "B2", 3)]


@pytest.mark.parametrize("order_by", ["ts", "offset"])
def test_table_join_equals_batch_when_all_arrives_at_once(spark, folder, order_by):
    rng = random.Random(order_by)

    def rows(tag):
        return [(f"{tag}{i}", {"id": rng.choice("hhhhab"), "v": None if i % 5 == 0 else i}, rng.randrange(40)) for i in range(60)]

    left, right = topic(spark, folder, "l", rows("L")), topic(spark, folder, "r", rows("R"))
    args = ("left", "right", ID)
    got = landed(spark, table_join_stream(left.stream(), right.stream(), *args, order_by=order_by), folder)
    same_objects(got, as_json(records(table_join_changelog(left.table(), right.table(), *args, order_by=order_by))))


def test_table_join_null_value_is_a_record(spark, folder):
    left, right = topic(spark, folder, "l", [("K", None, 0)]), topic(spark, folder, "r", [("K", {"v": 1}, 1)])
    got = landed(spark, table_join_stream(left.stream(), right.stream(), "left", "right", "key"), folder)
    assert [json.loads(v) for _, v, _ in got] == [
        {"left": {"key": "K", "value": None}, "right": {"key": "K", "value": {"v": 1}}}
    ]


AGGS = [Count("n"), Sum("amount", "s")]


def totals(df):
    return sorted((k, v["windowStart"], v["n"], v["s"]) for k, v, _ in records(df))


def test_aggregate_updates_reach_the_batch_result(spark, folder):
    rng = random.Random(1)
    files = [[(rng.choice("ab"), {"amount": i}, b * MINUTE + rng.randrange(MINUTE)) for i in range(10)] for b in range(3)]
    t = topic(spark, folder, "t", *files)
    stream = window_aggregate_stream(t.stream(), AGGS, MINUTE, 5 * MINUTE)
    run_to_end(upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint"))
    got = read_latest(spark, f"{folder}/table", ["key", "value.windowStart"])
    assert totals(got) == totals(window_aggregate(t.table(), AGGS, MINUTE))


def test_aggregate_append_emits_closed_windows_once(spark, folder):
    t = topic(spark, folder, "t", [("a", {"amount": 1}, 0), ("a", {}, 5)], [("a", {"amount": 4}, 10 * MINUTE)])
    stream = window_aggregate_stream(t.stream(), AGGS, MINUTE, 5_000)
    got = landed(spark, stream, folder)
    assert [(k, json.loads(v)["n"], json.loads(v)["s"]) for k, v, _ in got] == [("a", 2, 1.0)]


def test_aggregate_drops_late_records_of_a_later_batch(spark, folder):
    t = topic(spark, folder, "t", [("a", {}, 0)], [("a", {}, 70_000)], [("a", {}, 100)])
    stream = window_aggregate_stream(t.stream(), [Count("n")], MINUTE, 5_000)
    run_to_end(upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint"))
    got = read_latest(spark, f"{folder}/table", ["key", "value.windowStart"])
    want = window_aggregate(t.table(), [Count("n")], MINUTE, grace=5_000)
    counts = [sorted((v["windowStart"], v["n"]) for _, v, _ in records(df)) for df in (got, want)]
    assert counts[0] == counts[1] == [(0, 1), (MINUTE, 1)]


FILES = ([("a", {"v": 1}, 0), ("b", {"v": 2}, 0)], [("a", {"v": 3}, 0), ("a", {"v": 1}, 0)], [("b", {"v": 4}, 0)])


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns, F.variant_get("value", "$.v", "int")).collect())


@pytest.mark.parametrize("schema", [None, "v INT"])
def test_cache_set(spark, folder, schema):
    t = topic(spark, folder, "t", *FILES, schema=schema)
    run_to_end(cache_stream(t.stream(), "key", f"{folder}/table", f"{folder}/checkpoint"))
    got, want = read_cache_set(spark, f"{folder}/table"), cache_set(t.table(), "key")
    for df in (got, want):
        rows = sorted((r.key, r.v) for r in df.select("key", F.to_json("value").alias("v")).collect())
        assert rows == [("a", '{"v":1}'), ("b", '{"v":4}')]


def test_cache_list(spark, folder):
    t = topic(spark, folder, "t", *FILES)
    run_to_end(cache_stream(t.stream(), "key", f"{folder}/table", f"{folder}/checkpoint", "LIST_APPEND"))
    want = [("a", 0, 1), ("a", 1, 3), ("a", 2, 1), ("b", 0, 2), ("b", 1, 4)]
    for df in (read_cache_list(spark, f"{folder}/table", 1), cache_list(t.table(), "key")):
        assert values(df, "key", "position") == want


def test_replayed_batch_is_not_counted_twice(spark, folder):
    t = topic(spark, folder, "t", *FILES)
    write = batch_folder(f"{folder}/table")
    entries = t.table().select("key", "value", "partition", "offset")
    for _ in range(2):
        write(entries, 0)
    assert read_cache_list(spark, f"{folder}/table").count() == 5


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_stateless_operators_and_lookup(spark, folder, options):
    lookup = spark.createDataFrame([(1, "one"), (2, "two")], "id INT, name STRING")
    a, b = topic(spark, folder, "a", *FILES), topic(spark, folder, "b", [("c", {"v": 2}, 0), ("c", {"v": 9}, 0)])

    def job(left, right):
        kept = filter_(merge(left, right), F.variant_get("value", "$.v", "int") < 4)
        mapped = mapping(rekey(kept, path("v")), [("v", path("v")), ("from", FROM_KEY)])
        return enrich_lookup(mapped, lookup, [("key", "id")], [("name", "name")], **options)

    got = landed(spark, job(a.stream(), b.stream()), folder)
    assert got == sorted(as_json(records(job(a.table(), b.table()))))
    assert len(got) == 5


def test_batch_operators_name_their_streaming_form(spark, folder):
    e = topic(spark, folder, "t", *FILES).stream()
    for call, form in (
        (lambda: interval_join(e, e, "a", "b", "key", 1), "interval_join_stream"),
        (lambda: table_join_changelog(e, e, "a", "b", "key"), "table_join_stream"),
        (lambda: window_aggregate(e, AGGS, MINUTE), "window_aggregate_stream"),
        (lambda: cache_set(e, "key"), "cache_stream"),
        (lambda: cache_list(e, "key"), "cache_stream"),
    ):
        with pytest.raises(ValueError, match=form):
            call()


def test_fan_out(spark, folder):
    t = topic(spark, folder, "t", *FILES)
    seen = []
    sinks = [batch_folder(f"{folder}/all"), lambda batch, batch_id: seen.append((batch_id, batch.count()))]
    run_to_end(fan_out(t.stream(), sinks, f"{folder}/checkpoint"))
    assert seen == [(0, 2), (1, 2), (2, 1)]
    assert spark.read.parquet(f"{folder}/all").count() == 5


def test_malformed_record_stops_the_query(spark, folder):
    t = topic(spark, folder, "t", [("a", {"v": 1}, 0)])
    bad = raw(spark, [("a", {}, 0, 9)]).withColumn("value", F.lit("{"))
    bad.coalesce(1).write.mode("append").parquet(t.folder)
    with pytest.raises(Exception, match="MALFORMED"):
        run_to_end(topic_files_stream(t.stream(), f"{folder}/out", f"{folder}/checkpoint"))


def test_state_of_an_aggregate(spark, folder):
    t = topic(spark, folder, "t", [("a", {"amount": 2}, 0), ("a", {"amount": 3}, 1), ("b", {}, MINUTE)])
    stream = window_aggregate_stream(t.stream(), AGGS, MINUTE, 20 * MINUTE)
    run_to_end(upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint"))
    stores = list_state(spark, f"{folder}/checkpoint").collect()
    assert [(r.operatorId, r.stateStoreName, r.numPartitions) for r in stores] == [(0, "default", 2)]
    rows = dump_state(spark, f"{folder}/checkpoint").collect()
    got = sorted((json.loads(r.key)["key"], r.windowStart, r.windowEnd, json.loads(r.value)["sum"]) for r in rows)
    assert got == [("a", 0, MINUTE, 2), ("b", MINUTE, 2 * MINUTE, 1)]
    assert dump_state(spark, f"{folder}/checkpoint", limit=1).count() == 1
    by_partition = [dump_state(spark, f"{folder}/checkpoint", partition=p).count() for p in range(2)]
    assert sum(by_partition) == 2


def test_state_of_joins(spark, folder):
    left = topic(spark, folder, "l", [("a", {"id": "K"}, 1_000_000)])
    right = topic(spark, folder, "r", [("b", {"id": "K"}, 1_000_001)])
    run_to_end(
        topic_files_stream(
            table_join_stream(left.stream(), right.stream(), "left", "right", ID), f"{folder}/o1", f"{folder}/c1"
        )
    )
    entry = dump_state(spark, f"{folder}/c1").first()
    assert json.loads(entry.key) == {"key": "K"}
    state = json.loads(entry.value)["groupState"]
    assert (state["l_key"], state["r_key"], state["r_ms"]) == ("a", "b", 1_000_001)
    pairs = interval_join_stream(left.stream(), right.stream(), "left", "right", ID, 5_000, 30_000)
    run_to_end(topic_files_stream(pairs, f"{folder}/o2", f"{folder}/c2"))
    assert {r.stateStoreName.split("-")[0] for r in list_state(spark, f"{folder}/c2").collect()} == {"left", "right"}
    held = dump_state(spark, f"{folder}/c2", join_side="left").first()
    assert json.loads(held.value)["l_key"] == "K"


def test_settings(spark):
    assert trigger() == {"availableNow": True}
    assert trigger(500) == {"processingTime": "500 milliseconds"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, state_partitions=3, state_memory_mb=64, strict_lateness=False)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB") == "64"
        assert spark.conf.get("spark.sql.streaming.statefulOperator.allowMultiple") == "true"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage")
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB")


def test_work_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        assert work_folder(spark).startswith(base)
    assert work_folder(spark) != work_folder(spark)
