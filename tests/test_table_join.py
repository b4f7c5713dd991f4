import random

import pytest
from helpers import envelope, records
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keyedflow import path, table_join_changelog, table_join_latest

ID = path("id")


def updates(left, right, **options):
    return table_join_changelog(left, right, "left", "right", ID, **options)


def versions(df, *order):
    return [(v["left"]["value"]["v"], v["right"]["value"]["v"]) for _, v, _ in records(df, *(order or ("ts", "offset")))]


def v(spark, *rows):
    """Rows of ``(version, ms)`` for key K."""
    return envelope(spark, [(f"orig-{x}", {"id": "K", "v": x}, ms) for x, ms in rows])


def test_no_time_limit_and_original_keys(spark):
    left = envelope(spark, [("lk", {"id": "K", "v": "A"}, 0)])
    right = envelope(spark, [("rk", {"id": "K", "v": "B"}, 60_000)])
    assert records(updates(left, right)) == [
        (
            "K",
            {"left": {"key": "lk", "value": {"id": "K", "v": "A"}}, "right": {"key": "rk", "value": {"id": "K", "v": "B"}}},
            60_000,
        )
    ]


def test_update_joins_again(spark):
    assert versions(updates(v(spark, ("Alice", 0), ("Alice2", 2)), v(spark, ("O1", 1)))) == [
        ("Alice", "O1"),
        ("Alice2", "O1"),
    ]


def test_alternating_updates(spark):
    left, right = v(spark, ("A1", 0), ("A2", 2)), v(spark, ("B1", 1), ("B2", 3))
    assert versions(updates(left, right)) == [("A1", "B1"), ("A2", "B1"), ("A2", "B2")]


@pytest.mark.parametrize("order_by", ["ts", "offset"])
def test_equal_times_alternate_by_offset(spark, order_by):
    left, right = v(spark, ("A1", 0), ("A2", 0)), v(spark, ("B1", 0), ("B2", 0))
    got = versions(updates(left, right, order_by=order_by), "offset")
    assert got == [("A1", "B1"), ("A2", "B1"), ("A2", "B2")]


def test_one_side_alone_gives_nothing(spark):
    assert updates(v(spark, ("A", 0)), v(spark, ("B", 0)).where("false")).count() == 0


def test_null_value_does_not_delete(spark):
    left = envelope(spark, [("K", {"v": 1}, 0), ("K", None, 2)])
    right = envelope(spark, [("K", {"v": 2}, 1)])
    joined = table_join_changelog(left, right, "left", "right", "key")
    assert [r[1]["left"]["value"] for r in records(joined, "offset")] == [{"v": 1}, None]


def arrivals_by_hand(left, right, order):
    """What every arrival emits, one record at a time."""
    rows = [(*r, side) for side, rows in enumerate((left, right)) for r in rows]
    out, latest = [], ({}, {})
    for key, tag, ms, offset, side in sorted(rows, key=order):
        latest[side][key] = (tag, ms)
        if key in latest[0] and key in latest[1]:
            l, r = latest[0][key], latest[1][key]
            out.append((key, l[0], r[0], max(l[1], r[1]), 2 * offset + side))
    return out


ORDERS = {"ts": lambda r: (r[2], r[3], r[4]), "offset": lambda r: (r[3], r[4])}


def random_side(rng, name, n):
    """Mostly one hot key, with many records in one instant."""
    keys = ["hot"] * 6 + ["a", "b", "c"]
    return [
        (rng.choice(keys), f"{name}{i}", rng.choice([500, 500, rng.randrange(1000), rng.randrange(10**6)]), i)
        for i in range(n)
    ]


def side_frame(spark, rows):
    return envelope(spark, [(tag, {"id": key, "v": tag}, ms, offset) for key, tag, ms, offset in rows])


def emitted(df):
    rows = df.selectExpr(
        "key",
        "variant_get(value.left.value, '$.v', 'string') l",
        "variant_get(value.right.value, '$.v', 'string') r",
        "unix_millis(ts) ms",
        "offset",
    )
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("order_by", ["ts", "offset"])
@pytest.mark.parametrize("rows_per_chunk", [1, 2, 7, 50, 1_000_000])
def test_chunks_change_nothing(spark, order_by, rows_per_chunk):
    rng = random.Random(rows_per_chunk)
    left, right = random_side(rng, "L", 90), random_side(rng, "R", 90)
    got = emitted(updates(side_frame(spark, left), side_frame(spark, right), order_by=order_by, rows_per_chunk=rows_per_chunk))
    assert got == sorted(arrivals_by_hand(left, right, ORDERS[order_by]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_last_update_is_the_final_state(spark, data):
    def rows(name):
        side = data.draw(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50)), min_size=1, max_size=12))
        return [(k, f"{name}{i}", i, i) for i, (k, _) in enumerate(side)]

    left, right = side_frame(spark, rows("L")), side_frame(spark, rows("R"))
    last = {}
    for key, l, r, ms, offset in sorted(emitted(updates(left, right, order_by="offset", rows_per_chunk=3)), key=lambda r: r[4]):
        last[key] = (l, r, ms)
    final = records(table_join_latest(left, right, "left", "right", ID))
    assert last == {k: (x["left"]["value"]["v"], x["right"]["value"]["v"], ms) for k, x, ms in final}
