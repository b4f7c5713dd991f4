"""The query catalogue: every operator over the benchmark tables, flattened to plain columns.

Event times come out as epoch ms and double sums rounded to cents, so that results compare
by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedflow.functions.exprs import as_double, lenient_text, now_millis, path, template
from keyedflow.operators.aggregates import Count, Sum, drop_late, window_aggregate, window_aggregate_changelog
from keyedflow.operators.enrich import enrich_as_of, enrich_lookup
from keyedflow.operators.joins import interval_join, latest_by_key, table_join_changelog, table_join_latest
from keyedflow.operators.transforms import FROM_KEY, colocate, filter_, key_partition, mapping, merge, rekey
from keyedflow.plans import jobs, tables
from keyedflow.plans.runs import read_stream, run_in_parts, run_to_end, work_folder
from keyedflow.sinks.cache import cache_list, cache_set
from keyedflow.sinks.topics import encode, land, read_colocated, topic_files_stream, write_colocated, write_topic_files
from keyedflow.sources.envelope import decode
from keyedflow.sources.topics import read_topic_files
from keyedflow.streaming.aggregates import window_aggregate_stream
from keyedflow.streaming.intervals import interval_join_changes_stream
from keyedflow.streaming.joins import interval_join_stream, read_table_join, table_join_log
from keyedflow.streaming.lists import compact_list, list_stream, read_list
from keyedflow.streaming.running import drop_late_stream, read_steps, table_join_changes_stream, window_changelog_stream
from keyedflow.streaming.settings import configure
from keyedflow.streaming.sinks import (
    append_stream,
    batch_folder,
    cache_stream,
    fan_out,
    read_cache_list,
    read_cache_set,
    read_committed,
    read_latest,
    upsert_stream,
)
from keyedflow.streaming.state import dump_state, list_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_MS, HOUR_MS, TEN_MINUTES_MS = 86_400_000, 3_600_000, 600_000
TOTALS = (Count("n"), Sum("value", "total"))
# Streams over whole tables read files in any order: a delay that covers all times in them.
ALL_TIMES_MS = 36_500 * DAY_MS


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def ts_ms(column: str = "ts") -> Column:
    return F.unix_millis(column).alias("ts_ms")


def flat_totals(df: DataFrame, count: str = "n", total: str = "total") -> DataFrame:
    v = F.col("value")
    return df.select(
        "key",
        v[count].alias(count),
        F.round(v[total], 2).alias(total),
        v["windowStart"].alias("window_start"),
        v["windowEnd"].alias("window_end"),
        ts_ms(),
    )


def clicks_and_others(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All events as two streams."""
    return filter_(df, "value.event_type = 'click'"), filter_(df, "value.event_type <> 'click'")


# Sources and sinks


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw topic rows, with JSON text built by Spark."""
    df = tables.table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type"), F.col("user_id"), F.col("props")))
    return df.select(
        F.col("user_id").cast("string").alias("key"),
        body.alias("value"),
        F.col("ts").alias("timestamp"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )


@query
def source_json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = decode(raw_events(spark, sf_dir))
    return e.select(
        "key",
        path("event_type").cast("string").alias("event_type"),
        path("user_id").cast("bigint").alias("user_id"),
        path("absent").isNull().alias("absent"),
        "offset",
        ts_ms(),
    )


@query
def source_json_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = decode(raw_events(spark, sf_dir), "event_type STRING, user_id BIGINT")
    return e.select("key", "value.event_type", "value.user_id", "offset", ts_ms())


@query
def sink_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mapping(
        tables.events(spark, sf_dir),
        [("type", "value.event_type"), ("user", FROM_KEY), ("note", F.lit(None).cast("string"))],
    )
    return encode(e).select("key", F.col("value").alias("json"), "offset")


@query
def sink_topic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/topic"
    write_topic_files(tables.orders(spark, sf_dir), folder)
    landed = read_topic_files(spark, folder, "customerId STRING, amount DOUBLE")
    return landed.select("key", "value.customerId", "value.amount", "offset", ts_ms())


@query
def cache_set_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mapping(tables.events(spark, sf_dir), [("event_type", "value.event_type"), ("value", "value.value")])
    cached = cache_set(e, template(e, "user:@{key}"))
    return cached.select("key", "value.event_type", "value.value")


@query
def cache_list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = cache_list(tables.events(spark, sf_dir), "value.event_type")
    return cached.select("key", "position", "value.value")


@query
def cache_list_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = cache_list(tables.turns(spark, sf_dir), "key")
    return cached.select("key", "position", "value.role", "value.text")


# Projections, filters, keys, merge


@query
def mapping_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mapping(
        tables.events(spark, sf_dir),
        [
            ("user", FROM_KEY),
            ("kind", F.lit("overwritten")),
            ("source", F.lit("EVENTS")),
            ("doubled", "value.value * 2"),
            ("large", "value.value > 50"),
            ("kind", "value.event_type"),
            ("clock", now_millis() > 0),
        ],
    )
    return e.select("key", "value.*", ts_ms()).withColumn("doubled", F.round("doubled", 2))


@query
def mapping_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mapping(tables.events_json(spark, sf_dir), [("k", path("k")), ("user", FROM_KEY)])
    return e.select("key", F.col("value.k").cast("bigint").alias("k"), "value.user", "offset")


@query
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.orders(spark, sf_dir)
    return o.select("key", template(o, "order:@{key}:@{value.customerId}/@{value.status}").alias("text"))


@query
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = filter_(tables.events(spark, sf_dir), "value.value > 50", strict=False)
    return e.select("key", "value.event_type", "value.value", "offset")


@query
def filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = filter_(tables.events(spark, sf_dir), "value.value != 50 and value.event_type = 'click'")
    return e.select("key", "value.event_type", "value.value", "offset")


@query
def rekey_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rekey(tables.events_json(spark, sf_dir), path("k")).select("key", "offset", ts_ms())


@query
def key_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key that are not in the partition that ``key_partition`` names: none."""
    placed = colocate(tables.events(spark, sf_dir).select("key"), 16)
    away = F.abs(F.spark_partition_id() - key_partition(16)).alias("away")
    return placed.select("key", away).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").cast("bigint").alias("spread")
    )


@query
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    merged = merge(e, clicks_and_others(e)[0])
    return merged.select("key", "value.event_type", "offset")


@query
def scalar_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events_json(spark, sf_dir)
    return e.select(
        "key",
        "offset",
        as_double(e, path("k")).alias("number"),
        as_double(e, path("absent")).alias("absent_number"),
        lenient_text(e, path("k")).alias("text"),
        lenient_text(e, path("absent")).alias("absent_text"),
    )


# Joins


def flat_event_pairs(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    l, r = F.col("value")[left], F.col("value")[right]
    return df.select(
        "key",
        l["key"].alias("left_key"),
        l["value"]["event_type"].alias("left_type"),
        l["value"]["value"].alias("left_value"),
        r["key"].alias("right_key"),
        r["value"]["event_type"].alias("right_type"),
        r["value"]["value"].alias("right_value"),
        ts_ms(),
    )


@query
def interval_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    return flat_event_pairs(
        interval_join(*clicks_and_others(e), "left", "right", "key", TEN_MINUTES_MS)
    )


@query
def interval_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("customerId", "value.customerId"), ("orderId", "value.orderId")]
    o = mapping(tables.orders(spark, sf_dir), fields)
    pairs = interval_join(o, o, "a", "b", "value.customerId", TEN_MINUTES_MS)
    return pairs.select(
        "key",
        F.col("value.a.value.orderId").alias("a_order"),
        F.col("value.b.value.orderId").alias("b_order"),
        ts_ms(),
    )


@query
def interval_join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    return flat_event_pairs(interval_join(e, e, "left", "right", "key", TEN_MINUTES_MS))


@query
def interval_join_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys hold all events, which meet the totals of their type that end near them; buckets of time spread them."""
    e = rekey(tables.events(spark, sf_dir), "value.event_type")
    pairs = interval_join(e, window_aggregate(e, [Count("n")], HOUR_MS), "event", "hour", "key", TEN_MINUTES_MS)
    event, hour = F.col("value.event.value"), F.col("value.hour.value")
    return pairs.select(
        "key", event["value"].alias("value"), hour["n"].alias("n"), hour["windowStart"].alias("window_start"), ts_ms()
    )


def flat_customer_orders(df: DataFrame) -> DataFrame:
    c, o = F.col("value.customer"), F.col("value.order")
    return df.select(
        "key",
        c["key"].alias("customer_key"),
        c["value"]["name"].alias("name"),
        o["key"].alias("order_key"),
        o["value"]["amount"].alias("amount"),
        ts_ms(),
    )


def named_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cut to what the joins below show: a join holds whole values, so Spark cannot prune them."""
    fields = [("customerId", "value.customerId"), ("name", "value.name")]
    return mapping(tables.customers(spark, sf_dir), fields)


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("customerId", "value.customerId"), ("amount", "value.amount")]
    return mapping(tables.orders(spark, sf_dir), fields)


@query
def table_join_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = named_customers(spark, sf_dir), priced_orders(spark, sf_dir)
    return flat_customer_orders(
        table_join_changelog(customers, orders, "customer", "order", "value.customerId")
    )


@query
def table_join_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events(spark, sf_dir)
    return flat_event_pairs(
        table_join_changelog(*clicks_and_others(e), "left", "right", "key")
    )


@query
def table_join_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record has the same key, and both sides share one arrival sequence."""
    e = tables.events(spark, sf_dir)
    return flat_event_pairs(
        table_join_changelog(*clicks_and_others(e), "left", "right", F.lit("all"), order_by="offset")
    )


@query
def table_join_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = named_customers(spark, sf_dir), priced_orders(spark, sf_dir)
    return flat_customer_orders(
        table_join_latest(customers, orders, "customer", "order", "value.customerId")
    )


def colocated_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and orders as tables with one layout by customer."""
    out = []
    for df in (named_customers(spark, sf_dir), rekey(priced_orders(spark, sf_dir), "value.customerId")):
        folder = work_folder(spark)
        name = "colocated_" + folder.rpartition("/")[2].replace("-", "_")
        write_colocated(df, name, folder, 8)
        out.append(read_colocated(spark, name))
    return tuple(out)


@query
def colocated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of every customer, joined where the tables lie."""
    customers, orders = colocated_orders(spark, sf_dir)
    joined = table_join_latest(customers, orders, "customer", "order", "key", strict=False)
    v = F.col("value")
    return joined.select("key", v["customer"]["value"]["name"].alias("name"), v["order"]["value"]["amount"].alias("amount"), ts_ms())


@query
def colocated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, orders = colocated_orders(spark, sf_dir)
    return flat_totals(window_aggregate(orders, (Count("n"), Sum("amount", "total")), 30 * DAY_MS, strict=False))


@query
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rekey(tables.orders(spark, sf_dir), "value.customerId")
    latest = latest_by_key(mapping(orders, [("orderId", "value.orderId"), ("amount", "value.amount")]))
    return latest.select("key", "value.orderId", "value.amount", "offset", ts_ms())


@query
def enrich_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some nation keys have no match."""
    enriched = enrich_lookup(
        tables.customers(spark, sf_dir),
        tables.table(spark, sf_dir, "nation"),
        on=[("value.nationkey + 10", "n_nationkey")],
        fields=[("n_name", "nation"), ("n_regionkey", "segment")],
    )
    return enriched.select("key", "value.name", "value.nationkey", "value.nation", "value.segment")


def _orders_with_customer(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    enriched = enrich_lookup(
        tables.orders(spark, sf_dir),
        tables.table(spark, sf_dir, "customer"),
        on=[("value.customerId", "c_custkey")],
        fields=[("c_name", "name"), ("c_nationkey", "nation")],
        **options,
    )
    return enriched.select("key", "value.customerId", "value.amount", "value.name", "value.nation")


@query
def enrich_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_with_customer(spark, sf_dir)


@query
def enrich_customer_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for a lookup too large to broadcast."""
    return _orders_with_customer(spark, sf_dir, broadcast_bytes=0)


@query
def enrich_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many lookup rows per key: the customer's first order by number."""
    enriched = enrich_lookup(
        tables.customers(spark, sf_dir),
        tables.table(spark, sf_dir, "orders"),
        on=[("key", "o_custkey")],
        fields=[("o_orderkey", "firstOrder"), ("o_orderstatus", "status")],
        order_by=["o_orderkey"],
    )
    return enriched.select("key", "value.name", "value.firstOrder", "value.status")


@query
def enrich_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enrich_lookup(
        tables.events_json(spark, sf_dir),
        tables.table(spark, sf_dir, "nation"),
        on=[(path("k"), "n_nationkey")],
        fields=[("n_name", "nation")],
    )
    return e.select(
        "key",
        "offset",
        path("k").cast("bigint").alias("k"),
        path("nation").cast("string").alias("nation"),
        F.is_variant_null(path("nation")).alias("miss"),
    )


@query
def enrich_as_of_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events with the user's last click, which holds for six hours, or for good if its value is small."""
    _, others = clicks_and_others(tables.events(spark, sf_dir))
    clicks = tables.table(spark, sf_dir, "events").where("event_type = 'click'")
    enriched = enrich_as_of(
        others,
        clicks,
        on=[("key", "user_id")],
        fields=[("event_id", "click"), ("event_type", "props")],
        valid_from="ts",
        valid_to="CASE WHEN value >= 20 THEN ts + INTERVAL 6 HOURS END",
        order_by=["event_id"],
    )
    return enriched.select("key", "offset", "value.event_type", "value.click", "value.props")


@query
def enrich_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation whose band of prices they fall into; bands have gaps, and no key."""
    nations = tables.table(spark, sf_dir, "nation")
    enriched = enrich_as_of(
        tables.orders(spark, sf_dir),
        nations,
        on=[],
        fields=[("n_name", "band")],
        valid_from="n_nationkey * 20000",
        valid_to="n_nationkey * 20000 + 15000",
        at="cast(floor(value.amount) as bigint)",
    )
    return enriched.select("key", "value.amount", "value.band")


# Aggregates


@query
def aggregate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_totals(window_aggregate(tables.events(spark, sf_dir), TOTALS, DAY_MS))


@query
def aggregate_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_totals(
        window_aggregate(
            tables.events(spark, sf_dir), TOTALS, HOUR_MS, group_mode="GROUP_BY", key_extractor="value.event_type"
        )
    )


@query
def aggregate_lenient_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over text, JSON and an absent field."""
    e = mapping(
        tables.events(spark, sf_dir),
        [("text", "value.event_type"), ("number", "cast(value.value as string)")],
    )
    totals = (Sum("text", "text"), Sum("number", "number"), Sum("absent", "absent"), Count("n"))
    v = F.col("value")
    return window_aggregate(e, totals, DAY_MS).select(
        "key",
        v["text"].alias("text"),
        F.round(v["number"], 2).alias("number"),
        v["absent"].alias("absent"),
        v["n"].alias("n"),
        v["windowStart"].alias("window_start"),
    )


@query
def aggregate_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events_json(spark, sf_dir)
    return flat_totals(window_aggregate(e, (Count("n"), Sum("k", "total")), DAY_MS))


@query
def aggregate_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = window_aggregate_changelog(tables.events(spark, sf_dir), TOTALS, DAY_MS)
    return flat_totals(updates)


@query
def aggregate_updates_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = window_aggregate_changelog(
        tables.events(spark, sf_dir), TOTALS, 30 * DAY_MS, group_mode="GROUP_BY", key_extractor="value.event_type"
    )
    return flat_totals(updates)


def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive out of time order: each seventh one next, round and round."""
    e = tables.events(spark, sf_dir)
    rows = e.agg(F.count(F.lit(1))).scalar()
    return e.withColumn("offset", F.pmod(F.col("offset") * 7, rows))


@query
def late_drop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_late(shuffled_events(spark, sf_dir), HOUR_MS, 5_000)
    return kept.select("key", "value.event_type", "value.value", "offset", ts_ms())


@query
def late_drop_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_totals(window_aggregate(shuffled_events(spark, sf_dir), TOTALS, HOUR_MS, grace=5_000))


@query
def late_drop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_totals(window_aggregate_changelog(shuffled_events(spark, sf_dir), TOTALS, HOUR_MS, grace=5_000))


# Composed


@query
def join_into_cache_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join results, landed as a topic, appended to one list per user."""
    e = tables.events(spark, sf_dir)
    pairs = interval_join(*clicks_and_others(e), "left", "right", "key", TEN_MINUTES_MS)
    folder = f"{work_folder(spark)}/topic"
    land(mapping(pairs, [("at", F.unix_millis("ts"))]), folder)
    cached = cache_list(read_topic_files(spark, folder, "at BIGINT"), "key")
    return cached.select("key", "position", F.col("value.at").alias("ts_ms"))


@query
def updates_into_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog feeding an aggregate counts every update again."""
    e = tables.events(spark, sf_dir)
    joined = table_join_changelog(*clicks_and_others(e), "left", "right", "key")
    picked = mapping(joined, [("value", "value.right.value.value")])
    return flat_totals(window_aggregate(picked, TOTALS, DAY_MS))


@query
def job_customer_orders_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.customer_orders(tables.customers(spark, sf_dir), tables.orders(spark, sf_dir))
    return flat_customer_orders(job.joined)


@query
def job_customer_orders_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.customer_orders(tables.customers(spark, sf_dir), tables.orders_by_date(spark, sf_dir))
    return flat_totals(job.stats, "orderCount", "totalAmount")


@query
def job_order_stats_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics with nothing taken as late."""
    return flat_totals(jobs.order_stats(tables.orders(spark, sf_dir), grace=None), "orderCount", "totalAmount")


@query
def aggregate_into_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last window's totals of every user, as a key-value store keeps them."""
    totals = window_aggregate(tables.events(spark, sf_dir), TOTALS, DAY_MS)
    return flat_cached_totals(cache_set(totals, "key", order=["ts"]))


def flat_cached_totals(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.select("key", v["n"].alias("n"), F.round(v["total"], 2).alias("total"), v["windowStart"].alias("window_start"))


# Streaming: each query reads its table as a stream, runs to the end and reads its output.
# Their results don't depend on how the tables are cut into micro-batches.


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_envelope(read_stream(spark, sf_dir, "events"))


def stream_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.customers_envelope(read_stream(spark, sf_dir, "customer"))


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders_envelope(read_stream(spark, sf_dir, "orders"))


@query
def stream_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    filtered = filter_(stream_events(spark, sf_dir), "value.value > 50")
    run_to_end(topic_files_stream(filtered, f"{folder}/topic", f"{folder}/checkpoint"))
    landed = read_topic_files(spark, f"{folder}/topic", "event_type STRING, value DOUBLE")
    return landed.select("key", "value.event_type", "value.value", "offset")


@query
def stream_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = work_folder(spark)
    totals = window_aggregate_stream(stream_events(spark, sf_dir), TOTALS, DAY_MS, ALL_TIMES_MS)
    run_to_end(upsert_stream(totals, f"{folder}/table", f"{folder}/checkpoint"))
    return flat_totals(read_latest(spark, f"{folder}/table", ["key", "value.windowStart"]))


@query
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = work_folder(spark)
    clicks, others = clicks_and_others(stream_events(spark, sf_dir))
    pairs = interval_join_stream(
        clicks, others, "left", "right", "key", TEN_MINUTES_MS, 5_000, salts=2, disorder=ALL_TIMES_MS
    )
    run_to_end(topic_files_stream(pairs, f"{folder}/topic", f"{folder}/checkpoint"))
    landed = spark.read.parquet(f"{folder}/topic")
    event = "key STRING, value STRUCT<event_type STRING, value DOUBLE>"
    value = F.from_json("value", f"left STRUCT<{event}>, right STRUCT<{event}>")
    return flat_event_pairs(landed.select("key", value.alias("value"), F.col("timestamp").alias("ts")))


@query
def stream_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    customers, orders = stream_customers(spark, sf_dir), stream_orders(spark, sf_dir)
    run_to_end(table_join_log(customers, orders, "value.customerId", f"{folder}/log", f"{folder}/checkpoint"))
    return flat_customer_orders(read_table_join(spark, f"{folder}/log", "customer", "order"))


@query
def stream_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of the streaming job, with nothing taken as late."""
    configure(spark)
    folder = work_folder(spark)
    job = jobs.customer_orders_stream(stream_customers(spark, sf_dir), stream_orders(spark, sf_dir), ALL_TIMES_MS)
    run_to_end(upsert_stream(job.stats, f"{folder}/table", f"{folder}/checkpoint"))
    totals = read_latest(spark, f"{folder}/table", ["key", "value.windowStart"])
    return flat_totals(totals, "orderCount", "totalAmount")


# Running operators on streams: the records arrive in four parts, each a micro-batch of a restarted query.
PARTS = 4


@query
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are late against what earlier micro-batches brought."""
    folder = work_folder(spark)
    run_in_parts(
        shuffled_events(spark, sf_dir), "offset", PARTS, lambda e: drop_late_stream(e, HOUR_MS, 5_000, f"{folder}/kept", f"{folder}/c")
    )
    return read_steps(spark, f"{folder}/kept").select("key", "value.event_type", "value.value", "offset", ts_ms())


@query
def stream_aggregate_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per record, not per micro-batch."""
    folder = work_folder(spark)
    run_in_parts(
        tables.events(spark, sf_dir), "offset", PARTS, lambda e: window_changelog_stream(e, TOTALS, DAY_MS, f"{folder}/out", f"{folder}/c")
    )
    return flat_totals(read_steps(spark, f"{folder}/out"))


@query
def stream_late_drop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    run_in_parts(
        shuffled_events(spark, sf_dir), "offset", PARTS,
        lambda e: window_changelog_stream(e, TOTALS, HOUR_MS, f"{folder}/out", f"{folder}/c", grace=5_000),
    )
    return flat_totals(read_steps(spark, f"{folder}/out"))


@query
def stream_table_join_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against all other events of a user, latest by latest, as they arrive."""
    folder = work_folder(spark)
    run_in_parts(
        tables.events(spark, sf_dir).withColumn("at", F.unix_millis("ts")), "at", PARTS,
        lambda e: table_join_changes_stream(*clicks_and_others(e), "left", "right", "key", f"{folder}/out", f"{folder}/c"),
    )
    return flat_event_pairs(read_steps(spark, f"{folder}/out"))


@query
def stream_interval_join_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval join over waiting records, which expire, in time order."""
    folder = work_folder(spark)
    run_in_parts(
        tables.events(spark, sf_dir).withColumn("at", F.unix_millis("ts")), "at", PARTS,
        lambda e: interval_join_changes_stream(
            *clicks_and_others(e), "left", "right", "key", TEN_MINUTES_MS, 5_000, f"{folder}/out", f"{folder}/c"
        ),
    )
    return flat_event_pairs(read_steps(spark, f"{folder}/out"))


def _event_lists(spark: SparkSession, sf_dir: str) -> str:
    """Values of events by type, listed by a stream in parts, the first of them compacted."""
    folder = work_folder(spark)
    run_in_parts(
        tables.events(spark, sf_dir), "offset", PARTS, lambda e: list_stream(e, "value.event_type", f"{folder}/lists", f"{folder}/c")
    )
    compact_list(spark, f"{folder}/lists", PARTS - 2)
    return f"{folder}/lists"


@query
def stream_list_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_list(spark, _event_lists(spark, sf_dir)).select("key", "position", "value.value")


@query
def stream_list_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list out of all, from its bucket."""
    return read_list(spark, _event_lists(spark, sf_dir), ["click"]).select("key", "position", "value.value")


def _job_updates(spark: SparkSession, sf_dir: str, output: str) -> DataFrame:
    """The streaming job over customers and orders that arrive together, day by day."""
    folder = work_folder(spark)
    customers = tables.customers(spark, sf_dir).select("key", F.col("value").alias("customer"), "ts", "partition", "offset")
    orders = tables.orders_by_date(spark, sf_dir).select("key", F.col("value").alias("order"), "ts", "partition", "offset")
    both = customers.unionByName(orders, allowMissingColumns=True).withColumn("at", F.unix_millis("ts"))

    def start(rows: DataFrame):
        side = lambda name: rows.where(F.col(name).isNotNull()).select("key", F.col(name).alias("value"), "ts", "partition", "offset")
        return getattr(jobs.customer_orders_changes(side("customer"), side("order"), folder, f"{folder}/c"), output)

    run_in_parts(both, "at", PARTS, start)
    return read_steps(spark, f"{folder}/{output}")


@query
def stream_job_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_customer_orders(_job_updates(spark, sf_dir, "joined"))


@query
def stream_job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_totals(_job_updates(spark, sf_dir, "stats"), "orderCount", "totalAmount")


@query
def stream_enrich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless operators on streams: filter, merge, rekey, mapping and enrich."""
    folder, e = work_folder(spark), stream_events(spark, sf_dir)
    merged = merge(*clicks_and_others(e))
    keyed = rekey(merged, "value.event_type")
    fields = [("user", "cast(get_json_object(value.props, '$.k') as bigint)"), ("kind", F.lit("x")), ("at", "offset")]
    enriched = enrich_lookup(
        mapping(keyed, fields),
        tables.table(spark, sf_dir, "nation"),
        on=[("value.user", "n_nationkey")],
        fields=[("n_name", "kind")],
    )
    run_to_end(topic_files_stream(enriched, f"{folder}/topic", f"{folder}/checkpoint"))
    landed = read_topic_files(spark, f"{folder}/topic", "user BIGINT, kind STRING, at BIGINT")
    return landed.select("key", F.col("value.user").alias("k"), "value.kind", "value.at")


@query
def stream_cache_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, e = work_folder(spark), stream_events(spark, sf_dir)
    run_to_end(cache_stream(e, template(e, "user:@{key}"), f"{folder}/table", f"{folder}/checkpoint"))
    return read_cache_set(spark, f"{folder}/table").select("key", "value.event_type", "value.value")


@query
def stream_cache_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, e = work_folder(spark), stream_events(spark, sf_dir)
    run_to_end(cache_stream(e, "value.event_type", f"{folder}/table", f"{folder}/checkpoint", "LIST_APPEND"))
    return read_cache_list(spark, f"{folder}/table").select("key", "position", "value.value")


@query
def stream_aggregate_into_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a stream into a key-value store, one entry per user and window."""
    configure(spark)
    folder = work_folder(spark)
    totals = window_aggregate_stream(stream_events(spark, sf_dir), TOTALS, DAY_MS, ALL_TIMES_MS)
    key = F.concat_ws("@", "key", F.col("value.windowStart").cast("string"))
    cached = cache_stream(totals, key, f"{folder}/table", f"{folder}/checkpoint", order=["ts"], output_mode="update")
    run_to_end(cached)
    return flat_cached_totals(read_cache_set(spark, f"{folder}/table", order=["batch_id", "ts"]))


@query
def stream_join_into_cache_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a streaming join, landed as a topic, appended to one list per user by a second query."""
    configure(spark)
    folder, e = work_folder(spark), stream_events(spark, sf_dir)
    pairs = interval_join_stream(
        *clicks_and_others(e), "left", "right", "key", TEN_MINUTES_MS, 5_000, disorder=ALL_TIMES_MS
    )
    picked = mapping(pairs, [("at", F.unix_millis("ts"))])
    run_to_end(append_stream(picked, f"{folder}/pairs", f"{folder}/c1"))
    land(spark.read.parquet(f"{folder}/pairs"), f"{folder}/topic")
    landed = read_topic_files(spark, f"{folder}/topic", "at BIGINT", streaming=True)
    run_to_end(cache_stream(landed, "key", f"{folder}/list", f"{folder}/c2", "LIST_APPEND"))
    cached = read_cache_list(spark, f"{folder}/list")
    return cached.select("key", "position", F.col("value.at").alias("ts_ms"))


@query
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream to two sinks: all orders, and the total per status."""
    folder = work_folder(spark)
    all_orders, per_status = batch_folder(f"{folder}/orders"), batch_folder(f"{folder}/status")

    def status_totals(batch: DataFrame, batch_id: int) -> None:
        totals = batch.groupBy("value.status").agg(F.sum("value.amount").alias("amount"))
        per_status(totals, batch_id)

    run_to_end(fan_out(stream_orders(spark, sf_dir), [all_orders, status_totals], f"{folder}/checkpoint"))
    orders, status = spark.read.parquet(f"{folder}/orders"), spark.read.parquet(f"{folder}/status")
    counted = orders.groupBy(F.col("value.status").alias("status")).agg(F.count(F.lit(1)).alias("orders"))
    totals = status.groupBy("status").agg(F.round(F.sum("amount"), 2).alias("amount"))
    return counted.join(totals, "status")


@query
def stream_fan_out_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their number per status in two sinks that show a micro-batch together or not at all."""
    folder = work_folder(spark)
    all_orders, per_status = batch_folder(f"{folder}/orders"), batch_folder(f"{folder}/status")

    def status_counts(batch: DataFrame, batch_id: int) -> None:
        per_status(batch.groupBy("value.status").agg(F.count(F.lit(1)).alias("counted")), batch_id)

    run_in_parts(
        tables.orders(spark, sf_dir), "offset", PARTS,
        lambda o: fan_out(o, [all_orders, status_counts], f"{folder}/c", commits=f"{folder}/commits"),
    )
    orders, status = (read_committed(spark, f"{folder}/{name}", f"{folder}/commits") for name in ("orders", "status"))
    counted = orders.groupBy(F.col("value.status").alias("status")).agg(F.count(F.lit(1)).alias("orders"))
    return counted.join(status.groupBy("status").agg(F.sum("counted").alias("counted")), "status")


def _aggregate_checkpoint(spark: SparkSession, sf_dir: str) -> str:
    configure(spark)
    folder = work_folder(spark)
    # Windows far longer than the data stay open, so the state holds every key.
    totals = window_aggregate_stream(stream_events(spark, sf_dir), TOTALS, ALL_TIMES_MS, 5_000)
    run_to_end(upsert_stream(totals, f"{folder}/table", f"{folder}/checkpoint"))
    return f"{folder}/checkpoint"


@query
def state_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = list_state(spark, _aggregate_checkpoint(spark, sf_dir))
    return stores.select(F.col("operatorId").cast("bigint").alias("operator"), "operatorName", "stateStoreName")


@query
def state_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dump_state(spark, _aggregate_checkpoint(spark, sf_dir))
    return entries.select(
        F.get_json_object("key", "$.key").alias("key"),
        F.get_json_object("value", "$.sum").cast("bigint").alias("n"),
        "windowStart",
        "windowEnd",
    )
