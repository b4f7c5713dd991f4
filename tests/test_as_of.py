"""Lookups that hold for a time or a range, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from keyedflow import enrich_as_of

from helpers import at

SCHEMA = "key STRING, value STRUCT<v: INT, name: STRING>, ts TIMESTAMP, partition INT, offset BIGINT"
LOOKUP = "id STRING, start TIMESTAMP, stop TIMESTAMP, name STRING, rank INT, key STRING"


def case(seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    ms = lambda: rnd.randrange(2000)
    records = [(key(), (i, "own"), at(ms()), rnd.randrange(2), i) for i in range(300)]
    lookup = []
    for i in range(60):
        start = ms()
        lookup.append((key(), at(start) if rnd.random() < 0.95 else None, rnd.choice([None, at(start + rnd.randrange(-50, 500))]), f"n{i}", i, "x"))
    return records, lookup + lookup[:5]


def expected(records, lookup):
    for key, value, ts, partition, offset in records:
        rows = [r for r in lookup if key is not None and r[0] == key and r[1] is not None and r[1] <= ts]
        last = max((r[1] for r in rows), default=None)
        first = min((r for r in rows if r[1] == last), key=lambda r: r[4], default=None)
        yield offset, value[0], first[3] if first and (first[2] is None or ts < first[2]) else None


@pytest.mark.parametrize("seed, rows_per_chunk", [(1, 10**6), (2, 9), (3, 1)])
def test_as_of(spark, seed, rows_per_chunk):
    records, lookup = case(seed)
    df, table = spark.createDataFrame(records, SCHEMA), spark.createDataFrame(lookup, LOOKUP)
    got = enrich_as_of(df, table, [("key", "id")], [("name", "name")], "start", "stop", order_by=["rank"], strict=False, rows_per_chunk=rows_per_chunk)
    assert got.columns == df.columns
    rows = sorted((r.offset, r.value.v, r.value.name) for r in got.collect())
    assert rows == sorted(expected(records, lookup)) and any(r[2] for r in rows)


def test_ranges_without_key_and_open_ends(spark):
    df = spark.createDataFrame([("k", (v, None), at(0), 0, i) for i, v in enumerate([0, 5, 9, 10, 15, 99, -1, None])], SCHEMA)
    bands = spark.createDataFrame([(0, 10, "low"), (10, 12, "mid"), (20, None, "high")], "lo INT, hi INT, band STRING")
    for chunk in (10**6, 1):
        got = enrich_as_of(df, bands, [], [("band", "name")], "lo", "hi", at="value.v", rows_per_chunk=chunk)
        assert [r.value.name for r in got.orderBy("offset").collect()] == ["low", "low", "low", "mid", None, "high", None, None]
    # Without an end a band lasts until the next one starts.
    got = enrich_as_of(df, bands, [], [("band", "name")], "lo", at="value.v")
    assert [r.value.name for r in got.orderBy("offset").collect()] == ["low", "low", "low", "mid", "mid", "high", None, None]


def test_null_values_and_empty_lookups(spark):
    df = spark.createDataFrame([("k", None, at(0), 0, 0), ("k", (1, "x"), at(0), 0, 1)], SCHEMA)
    none = spark.createDataFrame([], LOOKUP)
    with pytest.raises(Exception, match="null value cannot be enriched"):
        enrich_as_of(df, none, [("key", "id")], [("name", "name")], "start").collect()
    rows = enrich_as_of(df.where("value is not null"), none, [("key", "id")], [("name", "name")], "start").collect()
    assert [(r.value.v, r.value.name) for r in rows] == [(1, None)]
    with pytest.raises(ValueError, match="valid_from"):
        enrich_as_of(df, none, [("key", "id")], [("name", "name")], None)


def test_nothing_is_compared_pair_by_pair(spark):
    records, lookup = case(4)
    df, table = spark.createDataFrame(records, SCHEMA), spark.createDataFrame(lookup, LOOKUP)
    got = enrich_as_of(df, table, [("key", "id")], [("name", "name")], "start", "stop", strict=False)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.select(F.count("*")).first()[0] == len(records)
