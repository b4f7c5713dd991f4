import pytest
from helpers import envelope, raw, records
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyedflow import (
    as_bool,
    as_double,
    as_node,
    as_text,
    colocate,
    decode,
    encode,
    filter_,
    key_partition,
    lenient_text,
    mapping,
    merge,
    now_millis,
    path,
    rekey,
    stream_of,
    template,
)
from keyedflow.operators.transforms import FROM_KEY


def one(spark, value, key="K1", schema=None):
    return envelope(spark, [(key, value, 0)], schema)


def eval1(df, column):
    return df.select(column.alias("c")).first()[0]


def test_text_of_field_and_key(spark):
    e = one(spark, {"id": "K", "n": 5, "f": 1.5, "b": True})
    assert [eval1(e, as_text(e, c)) for c in (path("id"), "key", path("n"), path("f"), path("b"))] == [
        "K", "K1", "5", "1.5", "true",
    ]


def test_text_of_nested_is_empty(spark):
    e = one(spark, {"o": {"a": 1}, "l": [1]})
    assert eval1(e, as_text(e, path("o"))) == "" and eval1(e, as_text(e, path("l"))) == ""
    typed = one(spark, {"o": {"a": 1}}, schema="o STRUCT<a INT>")
    assert eval1(typed, as_text(typed, "value.o")) == ""


@pytest.mark.parametrize("value", [{"x": None}, {}, None])
def test_text_of_null_or_missing_raises(spark, value):
    e = one(spark, value)
    with pytest.raises(PySparkException, match="null or missing"):
        eval1(e, as_text(e, path("x")))
    assert eval1(e, as_text(e, path("x"), strict=False)) is None


def test_boolean(spark):
    rows = [("a", {"amount": 100, "expected": 50}, 0), ("b", {"amount": 50, "expected": 50}, 0)]
    e = envelope(spark, rows, "amount INT, expected INT")
    assert [k for k, _, _ in records(filter_(e, "value.amount != value.expected"))] == ["a"]
    v = envelope(spark, rows)
    assert [k for k, _, _ in records(filter_(v, as_double(v, path("amount")) != as_double(v, path("expected"))))] == ["a"]


@pytest.mark.parametrize("text,flag", [("true", True), ("Yes", True), ("1", True), ("off", False), ("no", False)])
def test_boolean_of_text(spark, text, flag):
    e = one(spark, {"t": text}, schema="t STRING")
    assert eval1(e, as_bool(e, "value.t")) is flag


def test_boolean_of_numbers_and_bad_text(spark):
    e = one(spark, {"n": 2, "z": 0, "t": "maybe", "o": {"a": 1}}, schema="n INT, z INT, t STRING, o STRUCT<a INT>")
    assert eval1(e, as_bool(e, "value.n")) is True and eval1(e, as_bool(e, "value.z")) is False
    with pytest.raises(PySparkException, match="not a boolean"):
        eval1(e, as_bool(e, "value.t"))
    with pytest.raises(ValueError, match="not boolean"):
        as_bool(e, "value.o")


def test_null_predicate_raises_unless_lenient(spark):
    e = envelope(spark, [("a", {"x": 1}, 0), ("b", {}, 0)], "x INT")
    with pytest.raises(PySparkException, match="is null"):
        filter_(e, "value.x > 0").collect()
    assert [r.key for r in filter_(e, "value.x > 0", strict=False).collect()] == ["a"]


def test_mapping(spark):
    e = one(spark, {"amount": 100, "gone": 1, "n": None})
    got = records(
        mapping(
            e,
            [("who", FROM_KEY), ("fixed", F.lit("FIXED_VALUE")), ("amount", F.lit("first")), ("n", path("n")), ("amount", path("amount"))],
        )
    )
    assert got == [("K1", {"who": "K1", "fixed": "FIXED_VALUE", "amount": 100, "n": None}, 0)]
    assert list(got[0][1]) == ["who", "fixed", "amount", "n"]


def test_mapping_of_missing_raises(spark):
    e = one(spark, {"a": 1})
    with pytest.raises(PySparkException, match="is missing"):
        mapping(e, [("x", path("b"))]).collect()
    assert eval1(one(spark, {"b": None}), F.is_variant_null(as_node(e, path("b")))) is True


def test_mapping_clock(spark):
    got = records(mapping(one(spark, {}), [("now", now_millis())]))
    assert got[0][1]["now"] > 1_600_000_000_000


def test_double(spark):
    e = one(spark, {"n": 3, "s": " 12.5 ", "bad": "x", "null": None, "o": {}, "t": True})
    names = ["n", "s", "bad", "null", "o", "t", "missing"]
    assert [eval1(e, as_double(e, path(n))) for n in names] == [3.0, 12.5, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_lenient_text(spark):
    e = one(spark, {"s": "x", "n": 3, "o": {}, "null": None})
    assert [eval1(e, lenient_text(e, path(n))) for n in ("s", "n", "o", "null", "missing")] == ["x", "3", "", "null", ""]


def test_template(spark):
    typed = one(spark, {"orderId": "O1"}, schema="orderId STRING")
    assert eval1(typed, template(typed, "order:@{key}:@{value.orderId}")) == "order:K1:O1"
    variant = one(spark, {"orderId": "O1"})
    assert eval1(variant, template(variant, "@{variant_get(value, '$.orderId', 'string')}!")) == "O1!"


def test_rekey(spark):
    e = one(spark, {"id": 7})
    assert records(rekey(e, path("id"))) == [("7", {"id": 7}, 0)]
    with pytest.raises(PySparkException, match="null or missing"):
        rekey(e, path("none")).collect()


def test_path_takes_names_literally(spark):
    e = one(spark, {"a.b": 1, "it's": 2, "x": {"y": 3}})
    assert [eval1(e, as_text(e, path(*p))) for p in (["a.b"], ["it's"], ["x", "y"])] == ["1", "2", "3"]


def test_merge(spark):
    a, b = one(spark, {"x": 1}), one(spark, {"x": 2})
    assert merge(a).count() == 1
    assert merge(a, b).count() == 2
    assert sorted(v["x"] for _, v, _ in records(merge(a, b, a))) == [1, 1, 2]


def test_merge_of_topics_can_keep_arrival_unique(spark):
    a, b = one(spark, {"x": 1}), one(spark, {"x": 2})
    merged = merge(a, b, a, separate=True)
    assert sorted((r.partition, r.offset) for r in merged.collect()) == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize(
    "json,text",
    [("10.0", "10.0"), ("10.50", "10.5"), ("1e10", "1.0E10"), ("5", "5"), ("-7", "-7"), ("0.00001", "1.0E-5"), ("12345678901234567890", "12345678901234567890")],
)
def test_text_of_json_numbers(spark, json, text):
    e = decode(raw(spark, [("k", {}, 0)]).withColumn("value", F.lit(f'{{"n": {json}}}')))
    assert eval1(e, as_text(e, path("n"))) == eval1(e, lenient_text(e, path("n"))) == text


def test_path_with_both_quotes_is_refused():
    with pytest.raises(ValueError, match="quotes"):
        path("a'b\"c")


def test_same_key_same_partition(spark):
    e = envelope(spark, [(f"k{i % 7}", {}, i) for i in range(70)])
    placed = colocate(e, 5).select("key", F.spark_partition_id().alias("is"), key_partition(5).alias("told"))
    rows = placed.distinct().collect()
    assert len(rows) == 7 and all(r["is"] == r["told"] for r in rows)


def test_decode(spark):
    rows = raw(spark, [("k", {"a": 1}, 1234), ("gone", None, 5)])
    assert records(decode(rows), "ts") == [("gone", None, 5), ("k", {"a": 1}, 1234)]
    assert records(decode(rows, "a INT, b STRING"), "ts") == [("gone", None, 5), ("k", {"a": 1, "b": None}, 1234)]


@pytest.mark.parametrize("schema", [None, "a INT"])
def test_malformed_json_raises_unless_lenient(spark, schema):
    bad = raw(spark, [("k", {}, 0)]).withColumn("value", F.lit('{"a": '))
    # Raised on the JVM side, under a name that depends on the stage it happens in.
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        decode(bad, schema).collect()
    decode(bad, schema, strict=False).collect()


def test_decode_of_bytes(spark):
    rows = raw(spark, [("k", {"a": "ü"}, 0)])
    binary = rows.withColumn("key", F.encode("key", "UTF-8")).withColumn("value", F.encode("value", "UTF-8"))
    assert records(decode(binary)) == [("k", {"a": "ü"}, 0)]


def test_encode_keeps_nulls(spark):
    e = envelope(spark, [("a", {"x": None, "y": {"z": None}}, 0), ("b", None, 1)])
    assert [(r.key, r.value) for r in encode(e).orderBy("key").collect()] == [("a", '{"x":null,"y":{"z":null}}'), ("b", None)]
    typed = envelope(spark, [("a", {"x": None}, 0)], "x INT, y STRING")
    assert encode(typed).first().value == '{"x":null,"y":null}'


def test_stream_of_cuts_to_milliseconds(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'1970-01-01 00:00:01.234567' AS ts, 'x' AS v")
    e = stream_of(df, "id", F.struct("v"), "ts", "id")
    assert e.select(F.unix_micros("ts")).first()[0] == 1_234_000
    assert [f.dataType.simpleString() for f in e.schema] == ["string", "struct<v:string>", "timestamp", "int", "bigint"]


def test_zone_less_time_is_utc_in_any_session_zone(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-07-01 00:00:00' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert stream_of(df, "id", "id", "ts", "id").select(F.unix_millis("ts")).first()[0] == 1_719_792_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
