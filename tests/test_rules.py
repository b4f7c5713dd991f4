"""Arguments the operators accept and reject."""

from datetime import timedelta

import pytest
from helpers import envelope

from keyedflow import (
    Count,
    Sum,
    cache_set,
    enrich_lookup,
    filter_,
    interval_join,
    mapping,
    merge,
    read_topic_files,
    rekey,
    table_join_changelog,
    table_join_latest,
    window_aggregate,
    window_aggregate_changelog,
)
from keyedflow.sinks.cache import cache_sink
from keyedflow.sources.topics import kafka_options

MINUTES, SECONDS = timedelta(minutes=1), timedelta(seconds=1)


@pytest.fixture(scope="module")
def e(spark):
    return envelope(spark, [("k", {"id": "K"}, 0)])


def join(e, left="l", right="r", key="key", window=5 * SECONDS, grace=1 * SECONDS, join_type="INNER"):
    return interval_join(e, e, left, right, key, window, grace, join_type)


@pytest.mark.parametrize(
    "good",
    [
        {},
        {"window": 10 * MINUTES},
        {"window": timedelta(microseconds=1)},
        {"window": 1},
        {"grace": timedelta(0)},
        {"grace": 30 * SECONDS},
        {"join_type": "inner"},
    ],
)
def test_interval_join_accepts(e, good):
    join(e, **good)


BAD_SIDES = [
    {"left": ""},
    {"left": None},
    {"right": " "},
    {"right": None},
    {"left": "same", "right": "same"},
    {"key": ""},
    {"key": None},
    {"join_type": None},
    {"join_type": "LEFT"},
    {"join_type": "RIGHT"},
    {"join_type": "OUTER"},
]


@pytest.mark.parametrize(
    "bad",
    [
        *BAD_SIDES,
        {"window": None},
        {"window": timedelta(0)},
        {"window": -1 * SECONDS},
        {"window": 10 * MINUTES + timedelta(milliseconds=1)},
        {"window": 1.5},
        {"grace": None},
        {"grace": timedelta(milliseconds=-1)},
        {"grace": 30 * SECONDS + timedelta(milliseconds=1)},
    ],
)
def test_interval_join_rejects(e, bad):
    with pytest.raises(ValueError):
        join(e, **bad)


@pytest.mark.parametrize("bad", BAD_SIDES)
@pytest.mark.parametrize("operator", [table_join_changelog, table_join_latest])
def test_table_join_rejects(e, operator, bad):
    args = {"left": "l", "right": "r", "key": "key", "join_type": "INNER"} | bad
    with pytest.raises(ValueError):
        operator(e, e, args["left"], args["right"], args["key"], args["join_type"])


@pytest.mark.parametrize("operator", [window_aggregate, window_aggregate_changelog])
@pytest.mark.parametrize(
    "bad",
    [
        {"aggregations": []},
        {"aggregations": [Count("a"), Sum("x", "a")]},
        {"group_mode": None},
        {"group_mode": "GROUP_BY"},
        {"group_mode": "GROUP_BY", "key_extractor": " "},
        {"group_mode": "OTHER"},
        {"size": 0},
        {"size": -1},
        {"size": None},
        {"grace": -1},
        {"window_type": "SLIDING"},
        {"window_type": "SESSION"},
        {"window_type": None},
    ],
)
def test_aggregate_rejects(e, operator, bad):
    with pytest.raises(ValueError):
        operator(e, **({"aggregations": [Count("n")], "size": 1000} | bad))


def test_aggregate_accepts(e):
    window_aggregate(e, [Count("n")], 1, grace=0)
    window_aggregate(e, [Count("n")], MINUTES, key_extractor="", group_mode="GROUP_BY_KEY")


@pytest.mark.parametrize("make", [lambda: Sum("", "a"), lambda: Sum(None, "a"), lambda: Sum("x", " "), lambda: Count(None)])
def test_aggregation_rejects(make):
    with pytest.raises(ValueError):
        make()


@pytest.mark.parametrize(
    "call",
    [
        lambda e: mapping(e, []),
        lambda e: mapping(e, [("", "key")]),
        lambda e: mapping(e, [("a", None)]),
        lambda e: mapping(e, [("a", "")]),
        lambda e: filter_(e, ""),
        lambda e: filter_(e, None),
        lambda e: rekey(e, None),
        lambda e: rekey(e, " "),
        lambda e: merge(),
        lambda e: cache_set(e, ""),
        lambda e: cache_set(e, None),
        lambda e: cache_sink(e, "key", None),
        lambda e: cache_sink(e, "key", "PUSH"),
        lambda e: enrich_lookup(e, None, [], [("a", "b")]),
        lambda e: enrich_lookup(e, e, [("key", "key")], []),
        lambda e: enrich_lookup(e, e, [("key", "key")], [("", "b")]),
        lambda e: enrich_lookup(e, e, [("key", "key")], [("key", None)]),
        lambda e: kafka_options(" ", "h", False, 1),
        lambda e: read_topic_files(e.sparkSession, ""),
        lambda e: table_join_changelog(e, e, "l", "r", "key", order_by="time"),
    ],
)
def test_other_operators_reject(e, call):
    with pytest.raises(ValueError):
        call(e)


def test_syntax_and_unknown_names_fail_before_running(e):
    from pyspark.errors import AnalysisException, ParseException

    with pytest.raises(ParseException):
        filter_(e, "value. >")
    with pytest.raises(AnalysisException):
        rekey(e, "no_such_column")
