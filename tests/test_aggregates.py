import random
from collections import defaultdict

import pytest
from helpers import envelope, records
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyedflow import Count, Sum, drop_late, path, window_aggregate, window_aggregate_changelog

CUSTOMER = path("customerId")
MINUTE = 60_000


def last_per_key(df):
    return {k: v for k, v, _ in records(df)}


def grouped(df, *aggs, size=MINUTE, **options):
    return window_aggregate(df, list(aggs), size, group_mode="GROUP_BY", key_extractor=CUSTOMER, **options)


def amounts(spark, *rows):
    return envelope(spark, [(f"k{i}", {"customerId": c, "amount": a}, 0) for i, (c, a) in enumerate(rows)])


def test_sum(spark):
    got = last_per_key(grouped(amounts(spark, ("C1", 10), ("C1", 15), ("C2", 100)), Sum("amount", "totalAmount"), grace=0))
    assert got["C1"] == {"totalAmount": 25.0, "windowStart": 0, "windowEnd": MINUTE}
    assert got["C2"]["totalAmount"] == 100.0


def test_count(spark):
    e = envelope(spark, [("a", {"customerId": "C1"}, 0), ("b", {"customerId": "C1"}, 0)])
    assert last_per_key(grouped(e, Count("eventCount")))["C1"]["eventCount"] == 2


def test_count_and_sum(spark):
    got = last_per_key(grouped(amounts(spark, ("C1", 10), ("C1", 15)), Count("eventCount"), Sum("amount", "totalAmount")))
    assert got["C1"] == {"eventCount": 2, "totalAmount": 25.0, "windowStart": 0, "windowEnd": MINUTE}


def test_sum_takes_missing_and_non_numeric_as_zero(spark):
    values = [{"x": 1}, {"amount": None}, {"amount": "12.5"}, {"amount": True}, {"amount": "abc"}, {"amount": {"a": 1}}, {"amount": [1]}]
    e = envelope(spark, [("K", v, 0) for v in values])
    assert last_per_key(window_aggregate(e, [Sum("amount", "s")], MINUTE))["K"]["s"] == 13.5
    only_missing = envelope(spark, [("K", {"x": 1}, 0)])
    assert last_per_key(window_aggregate(only_missing, [Sum("amount", "s")], MINUTE))["K"]["s"] == 0.0


def test_sum_field_name_is_not_a_path(spark):
    e = envelope(spark, [("K", {"a.b": 3, "a": {"b": 100}, "it's": 4}, 0)])
    got = last_per_key(window_aggregate(e, [Sum("a.b", "s"), Sum("it's", "t")], MINUTE))["K"]
    assert (got["s"], got["t"]) == (3.0, 4.0)


def test_window_bounds_replace_an_alias(spark):
    e = envelope(spark, [("K", {}, 0)])
    assert last_per_key(window_aggregate(e, [Count("windowStart"), Count("n")], MINUTE))["K"] == {
        "windowStart": 0,
        "n": 1,
        "windowEnd": MINUTE,
    }


def test_window_start_is_inclusive_and_end_exclusive(spark):
    e = envelope(spark, [("K", {}, 59_999), ("K", {}, 60_000), ("K", {}, -1)])
    got = sorted((v["windowStart"], v["n"], ms) for _, v, ms in records(window_aggregate(e, [Count("n")], MINUTE)))
    assert got == [(-60_000, 1, -1), (0, 1, 59_999), (60_000, 1, 60_000)]


def test_null_keys_and_values_do_not_count(spark):
    e = envelope(spark, [("K", {}, 0), (None, {}, 0), ("K", None, 0)])
    assert [(k, v["n"]) for k, v, _ in records(window_aggregate(e, [Count("n")], MINUTE))] == [("K", 1)]


def test_group_by_missing_key_raises(spark):
    with pytest.raises(PySparkException, match="null or missing"):
        grouped(envelope(spark, [("K", {"x": 1}, 0)]), Count("n")).collect()


@pytest.mark.parametrize("times,kept", [((0, 70_000, 100), [0, 70_000]), ((0, 64_999, 100), [0, 64_999, 100])])
@pytest.mark.parametrize("rows_per_chunk", [1, 2, 1000])
def test_late_drop(spark, times, kept, rows_per_chunk):
    e = envelope(spark, [("K", {}, t) for t in times])
    got = drop_late(e, MINUTE, 5_000, rows_per_chunk=rows_per_chunk)
    assert [ms for _, _, ms in records(got, "offset")] == kept


def test_late_drop_per_partition(spark):
    e = envelope(spark, [("K", {}, 70_000, 0, 0), ("K", {}, 100, 0, 1), ("K", {}, 100, 1, 0)])
    assert sorted((r.partition, r.offset) for r in drop_late(e, MINUTE, 5_000).collect()) == [(0, 0), (1, 0)]


def events(rng, n):
    return [
        (rng.choice(["hot"] * 5 + ["a", "b"]), rng.randrange(1, 9), rng.randrange(300_000), i, rng.randrange(3))
        for i in range(n)
    ]


def updates_by_hand(rows, size, grace):
    """One record at a time, by partition and offset."""
    out, stream_time, totals = [], defaultdict(lambda: -1), defaultdict(lambda: [0, 0.0, -1])
    for key, amount, ms, offset, partition in sorted(rows, key=lambda r: (r[4], r[3])):
        stream_time[partition] = max(stream_time[partition], ms)
        start = ms - ms % size
        if grace is not None and start + size <= stream_time[partition] - grace:
            continue
        t = totals[key, start]
        t[0], t[1], t[2] = t[0] + 1, t[1] + amount, max(t[2], ms)
        out.append((partition, offset, key, start, *t))
    return out


@pytest.mark.parametrize("rows_per_chunk", [1, 3, 40, 1_000_000])
@pytest.mark.parametrize("grace", [None, 20_000])
def test_changelog_and_final_against_one_record_at_a_time(spark, rows_per_chunk, grace):
    rows = events(random.Random(rows_per_chunk), 200)
    e = envelope(spark, [(k, {"amount": a}, ms, offset, p) for k, a, ms, offset, p in rows])
    aggs = [Count("n"), Sum("amount", "s")]
    want = updates_by_hand(rows, MINUTE, grace)
    options = {"grace": grace, "rows_per_chunk": rows_per_chunk}
    flat = ["value.windowStart", "value.n", "value.s", F.unix_millis("ts")]

    updates = window_aggregate_changelog(e, aggs, MINUTE, **options)
    assert sorted(tuple(r) for r in updates.select("partition", "offset", "key", *flat).collect()) == sorted(want)

    last = {(key, start): (n, s, ms) for _, _, key, start, n, s, ms in want}
    final = window_aggregate(e, aggs, MINUTE, **options).select("key", *flat).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in final} == last


def test_changelog_feeds_another_aggregate(spark):
    e = envelope(spark, [("K", {"amount": 1}, i) for i in range(4)])
    first = window_aggregate_changelog(e, [Sum("amount", "s")], MINUTE)
    second = window_aggregate_changelog(first, [Count("n"), Sum("s", "t")], MINUTE)
    got = [(v["n"], v["t"]) for _, v, _ in records(second, "offset")]
    assert got == [(1, 1.0), (2, 3.0), (3, 6.0), (4, 10.0)]
