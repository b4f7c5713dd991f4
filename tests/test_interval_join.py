import random

import pytest
from helpers import envelope, records

from keyedflow import interval_join, path

BASE = 100_000
ID = path("id")


def join(left, right, window=5000, grace=1000, key=ID, **options):
    return interval_join(left, right, "left", "right", key, window, grace, **options)


def ids(spark, *rows):
    return envelope(spark, [(f"orig-{i}", {"id": k}, ms) for i, (k, ms) in enumerate(rows)])


def test_match_keeps_original_records(spark):
    left = envelope(spark, [("original-left-key", {"id": "K", "name": "Alice"}, 1000)])
    right = envelope(spark, [("original-right-key", {"id": "K", "orderId": "O1"}, 1000)])
    assert records(join(left, right)) == [
        (
            "K",
            {
                "left": {"key": "original-left-key", "value": {"id": "K", "name": "Alice"}},
                "right": {"key": "original-right-key", "value": {"id": "K", "orderId": "O1"}},
            },
            1000,
        )
    ]


def test_missing_join_key_raises(spark):
    left = envelope(spark, [("k1", {"name": "Alice"}, 0)])
    # Several stages fail at once, which Spark reports in an exception of its own.
    with pytest.raises(Exception, match="null or missing"):
        join(left, ids(spark, ("K", 0))).collect()


def test_output_key_is_the_selected_text(spark):
    assert [r[0] for r in records(join(ids(spark, ("001", BASE)), ids(spark, ("001", BASE))))] == ["001"]


@pytest.mark.parametrize("left,right", [([("001", BASE)], [("002", BASE)]), ([("K", BASE)], [("K", BASE + 20_000)])])
def test_no_match(spark, left, right):
    assert join(ids(spark, *left), ids(spark, *right)).count() == 0


@pytest.mark.parametrize("shift,rows", [(0, 1), (5000, 1), (-5000, 1), (5001, 0), (-5001, 0)])
def test_bounds_are_inclusive(spark, shift, rows):
    assert join(ids(spark, ("K", BASE)), ids(spark, ("K", BASE + shift)), grace=0).count() == rows


def test_many_to_many(spark):
    left, right = ids(spark, *[("match", BASE)] * 2), ids(spark, *[("match", BASE)] * 3)
    assert join(left, right).count() == 6


def test_left_alone_gives_nothing(spark):
    assert join(ids(spark, ("K", BASE)), ids(spark, ("K", BASE)).where("false")).count() == 0


def test_output_time_is_the_later_one(spark):
    assert records(join(ids(spark, ("K", BASE)), ids(spark, ("K", BASE + 2000))))[0][2] == BASE + 2000


def test_self_join_has_all_ordered_pairs(spark):
    e = ids(spark, *[("K", BASE)] * 4)
    assert join(e, e).count() == 16


def test_nested_empty_and_meta_values_are_untouched(spark):
    left = envelope(spark, [("a", {"outer": {"inner": [1, 2]}}, 0), ("b", {}, 0)])
    right = envelope(spark, [("a", {"id": "1", "_meta": {"source": "x"}}, 0), ("b", {}, 0)])
    got = {key: value for key, value, _ in records(join(left, right, key="key"))}
    assert got["a"]["left"]["value"] == {"outer": {"inner": [1, 2]}}
    assert got["a"]["right"]["value"] == {"id": "1", "_meta": {"source": "x"}}
    assert got["b"] == {"left": {"key": "b", "value": {}}, "right": {"key": "b", "value": {}}}
    assert all(set(v) == {"left", "right"} for v in got.values())


def test_null_value_joins_on_a_key_only_selector(spark):
    e = envelope(spark, [("K", None, 0)])
    assert records(join(e, e, key="key")) == [
        ("K", {"left": {"key": "K", "value": None}, "right": {"key": "K", "value": None}}, 0)
    ]


def test_times_before_the_epoch(spark):
    assert join(ids(spark, ("K", -3)), ids(spark, ("K", 4)), window=7).count() == 1
    assert join(ids(spark, ("K", -4)), ids(spark, ("K", 4)), window=7).count() == 0


@pytest.mark.parametrize("rows_per_task", [1, 3, 1_000_000])
@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_splitting_hot_groups_changes_nothing(spark, rows_per_task, hot):
    rng = random.Random(f"{rows_per_task}{hot}")

    def side(n, hot_n, salt):
        rows = [(f"k{rng.randrange(4)}", rng.randrange(20_000)) for _ in range(n)]
        return rows + [("hot", 7_000 + rng.randrange(3)) for _ in range(hot_n)]

    left = side(60, 80 if hot in ("left", "both") else 3, 1)
    right = side(60, 80 if hot in ("right", "both") else 3, 2)
    want = sorted(
        (k, f"orig-{i}", f"orig-{j}", max(a, b))
        for i, (k, a) in enumerate(left)
        for j, (m, b) in enumerate(right)
        if k == m and abs(a - b) <= 700
    )
    joined = join(ids(spark, *left), ids(spark, *right), window=700, rows_per_task=rows_per_task)
    got = sorted((k, v["left"]["key"], v["right"]["key"], ms) for k, v, ms in records(joined))
    assert got == want


def test_typed_values(spark):
    rows = [("a", {"id": "K", "n": 1}, 0)]
    e = envelope(spark, rows, "id STRING, n INT")
    joined = join(e, e, key="value.id")
    assert joined.select("value.left.value.n").first()[0] == 1
