"""The catalogue's queries in plain SQL, for checking the results in another engine."""

from __future__ import annotations

DAY, HOUR = 86_400_000, 3_600_000
# Times are cut to whole ms; epoch_ms would round them.
MS = "(epoch_us(ts) // 1000)"


def totals(source: str, key: str, size: int, ms: str = MS, value: str = "value", n: str = "n", total: str = "total") -> str:
    start = f"{ms} - {ms} % {size}"
    return f"""
        SELECT {key} AS key, count(*) AS {n}, round(sum({value}), 2) AS {total},
               {start} AS window_start, {start} + {size} AS window_end, max({ms}) AS ts_ms
        FROM {source} GROUP BY {key}, {start}"""


def updates(
    source: str, key: str, size: int, order: str, ms: str = MS, value: str = "value", n: str = "n", total: str = "total"
) -> str:
    start = f"{ms} - {ms} % {size}"
    over = f"(PARTITION BY {key}, {start} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""
        SELECT {key} AS key, count(*) OVER {over} AS {n}, round(sum({value}) OVER {over}, 2) AS {total},
               {start} AS window_start, {start} + {size} AS window_end, max({ms}) OVER {over} AS ts_ms
        FROM {source}"""


def on_time(source: str, arrival: str, ms: str, size: int, grace: int) -> str:
    """Rows whose window was open on arrival."""
    return f"""(
        SELECT * FROM (
            SELECT *, {arrival} AS arrival,
                   max({ms}) OVER (ORDER BY {arrival} ROWS UNBOUNDED PRECEDING) AS stream_time
            FROM {source})
        WHERE {ms} - {ms} % {size} + {size} > stream_time - {grace})"""


USER = "cast(user_id AS varchar)"
SHUFFLED = on_time("events", "(event_id * 7) % (SELECT count(*) FROM events)", MS, HOUR, 5_000)

PAIR = """{key} AS key, cast(l.user_id AS varchar) AS left_key, l.event_type AS left_type, l.value AS left_value,
       cast(r.user_id AS varchar) AS right_key, r.event_type AS right_type, r.value AS right_value,
       greatest((epoch_us(l.ts) // 1000), (epoch_us(r.ts) // 1000)) AS ts_ms"""


def interval_pairs(on: str, key: str, window: int, where: str = "true") -> str:
    return f"""
        SELECT {PAIR.format(key=key)}
        FROM events l JOIN events r ON {on} AND abs((epoch_us(l.ts) // 1000) - (epoch_us(r.ts) // 1000)) <= {window}
        WHERE {where}"""


CLICK_OTHER = interval_pairs(
    "l.user_id = r.user_id",
    "cast(l.user_id AS varchar)",
    600_000,
    "l.event_type = 'click' AND r.event_type <> 'click'",
)

CUSTOMER_ORDERS = """
    WITH arrivals AS (
        SELECT cast(c_custkey AS varchar) AS key, 0 AS ms, c_custkey AS pos, 0 AS side,
               {'k': cast(c_custkey AS varchar), 'name': c_name} AS c, NULL AS o
        FROM customer
        UNION ALL
        SELECT cast(o_custkey AS varchar), (epoch_us(o_orderdate) // 1000), o_orderkey, 1, NULL,
               {'k': cast(o_orderkey AS varchar), 'amount': o_totalprice, 'ms': (epoch_us(o_orderdate) // 1000)}
        FROM orders),
    paired AS (
        SELECT key, last_value(c IGNORE NULLS) OVER w AS c, last_value(o IGNORE NULLS) OVER w AS o
        FROM arrivals
        WINDOW w AS (PARTITION BY key ORDER BY ms, pos, side ROWS UNBOUNDED PRECEDING))
    SELECT key, c.k AS customer_key, c.name AS name, o.k AS order_key, o.amount AS amount, o.ms AS ts_ms
    FROM paired WHERE c IS NOT NULL AND o IS NOT NULL"""


def event_table_join(key: str, order: str) -> str:
    held = "{'k': cast(user_id AS varchar), 't': event_type, 'v': value, 'ms': (epoch_us(ts) // 1000)}"
    return f"""
        SELECT key, l.k AS left_key, l.t AS left_type, l.v AS left_value,
               r.k AS right_key, r.t AS right_type, r.v AS right_value, greatest(l.ms, r.ms) AS ts_ms
        FROM (
            SELECT {key} AS key,
                   last_value(CASE WHEN event_type = 'click' THEN {held} END IGNORE NULLS) OVER w AS l,
                   last_value(CASE WHEN event_type <> 'click' THEN {held} END IGNORE NULLS) OVER w AS r
            FROM events
            WINDOW w AS (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING))
        WHERE l IS NOT NULL AND r IS NOT NULL"""


PAIR_LISTS = f"""
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts_ms) - 1 AS position, ts_ms
    FROM ({CLICK_OTHER})"""

LAST_EVENT = f"""
    SELECT 'user:' || {USER} AS key, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
    FROM events GROUP BY user_id"""

EVENT_LISTS = """
    SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position, value
    FROM events"""

WITH_CUSTOMER = """
    SELECT cast(o_orderkey AS varchar) AS key, cast(o_custkey AS varchar) AS "customerId", o_totalprice AS amount,
           c_name AS name, cast(c_nationkey AS varchar) AS nation
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""

ORDER_DAYS = "(epoch_us(o_orderdate) // 1000)"
K = "cast(json_extract(props, '$.k') AS bigint)"

ORACLE: dict[str, str] = {
    "source_json_variant": f"""
        SELECT {USER} AS key, event_type, user_id, true AS absent, event_id AS "offset", {MS} AS ts_ms FROM events""",
    "source_json_typed": f"""
        SELECT {USER} AS key, event_type, user_id, event_id AS "offset", {MS} AS ts_ms FROM events""",
    "sink_json_text": f"""
        SELECT {USER} AS key, event_id AS "offset",
               '{{"type":"' || event_type || '","user":"' || {USER} || '","note":null}}' AS json
        FROM events""",
    "sink_topic_files": f"""
        SELECT cast(o_orderkey AS varchar) AS key, cast(o_custkey AS varchar) AS "customerId",
               o_totalprice AS amount, o_orderkey AS "offset", {ORDER_DAYS} AS ts_ms FROM orders""",
    "cache_set_last_event": LAST_EVENT,
    "cache_list_events": EVENT_LISTS,
    "cache_list_conversation": """
        SELECT cast(conv_id AS varchar) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
               role, text FROM conversations""",
    "mapping_fields": f"""
        SELECT {USER} AS key, {USER} AS "user", event_type AS kind, 'EVENTS' AS source, round(value * 2, 2) AS doubled,
               value > 50 AS large, true AS clock, {MS} AS ts_ms FROM events""",
    "mapping_variant": f"""
        SELECT {USER} AS key, {K} AS k, {USER} AS "user", event_id AS "offset" FROM events""",
    "template_text": """
        SELECT cast(o_orderkey AS varchar) AS key,
               'order:' || o_orderkey || ':' || o_custkey || '/' || o_orderstatus AS text FROM orders""",
    "filter_values": f"""
        SELECT {USER} AS key, event_type, value, event_id AS "offset" FROM events WHERE value > 50""",
    "filter_strict": f"""
        SELECT {USER} AS key, event_type, value, event_id AS "offset" FROM events
        WHERE value <> 50 AND event_type = 'click'""",
    "rekey_json_field": f"""
        SELECT json_extract_string(props, '$.k') AS key, event_id AS "offset", {MS} AS ts_ms FROM events""",
    "key_placement": f"""
        SELECT {USER} AS key, count(*) AS n, cast(0 AS bigint) AS spread FROM events GROUP BY user_id""",
    "merge_events": f"""
        SELECT {USER} AS key, event_type, event_id AS "offset" FROM events
        UNION ALL SELECT {USER}, event_type, event_id FROM events WHERE event_type = 'click'""",
    "scalar_conversions": f"""
        SELECT {USER} AS key, event_id AS "offset",
               coalesce(try_cast(json_extract_string(props, '$.k') AS double), 0) AS number,
               coalesce(try_cast(json_extract_string(props, '$.absent') AS double), 0) AS absent_number,
               coalesce(json_extract_string(props, '$.k'), '') AS text,
               coalesce(json_extract_string(props, '$.absent'), '') AS absent_text
        FROM events""",
    "interval_join_events": CLICK_OTHER,
    "interval_join_orders": f"""
        SELECT cast(a.o_custkey AS varchar) AS key, a.o_orderkey AS a_order, b.o_orderkey AS b_order,
               greatest((epoch_us(a.o_orderdate) // 1000), (epoch_us(b.o_orderdate) // 1000)) AS ts_ms
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
         AND abs((epoch_us(a.o_orderdate) // 1000) - (epoch_us(b.o_orderdate) // 1000)) <= 600000""",
    "interval_join_self": interval_pairs("l.user_id = r.user_id", "cast(l.user_id AS varchar)", 600_000),
    "interval_join_few_keys": f"""
        SELECT key, value, n, window_start, greatest(ms, ts_ms) AS ts_ms
        FROM (SELECT event_type, value, {MS} AS ms FROM events) JOIN ({totals("events", "event_type", HOUR)})
          ON event_type = key AND abs(ms - ts_ms) <= 600000""",
    "table_join_updates": CUSTOMER_ORDERS,
    "table_join_interleaved": event_table_join(USER, "(epoch_us(ts) // 1000), event_id"),
    "table_join_one_key": event_table_join("'all'", "event_id"),
    "table_join_final": """
        SELECT cast(c_custkey AS varchar) AS key, cast(c_custkey AS varchar) AS customer_key, c_name AS name,
               cast(max(o_orderkey) AS varchar) AS order_key, arg_max(o_totalprice, o_orderkey) AS amount,
               (epoch_us(arg_max(o_orderdate, o_orderkey)) // 1000) AS ts_ms
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "colocated_join": """
        SELECT cast(c_custkey AS varchar) AS key, c_name AS name, arg_max(o_totalprice, o_orderkey) AS amount,
               (epoch_us(arg_max(o_orderdate, o_orderkey)) // 1000) AS ts_ms
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "colocated_totals": totals("orders", "cast(o_custkey AS varchar)", 30 * DAY, ORDER_DAYS, "o_totalprice"),
    "latest_order": f"""
        SELECT cast(o_custkey AS varchar) AS key, max(o_orderkey) AS "orderId",
               arg_max(o_totalprice, o_orderkey) AS amount, max(o_orderkey) AS "offset",
               arg_max({ORDER_DAYS}, o_orderkey) AS ts_ms
        FROM orders GROUP BY o_custkey""",
    "enrich_nation": """
        SELECT cast(c_custkey AS varchar) AS key, c_name AS name, c_nationkey AS nationkey, n_name AS nation,
               cast(n_regionkey AS varchar) AS segment
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 10""",
    "enrich_customer": WITH_CUSTOMER,
    "enrich_customer_shuffled": WITH_CUSTOMER,
    "enrich_first_row": """
        SELECT cast(c_custkey AS varchar) AS key, c_name AS name, cast(min(o_orderkey) AS varchar) AS "firstOrder",
               arg_min(o_orderstatus, o_orderkey) AS status
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "enrich_variant": f"""
        SELECT {USER} AS key, event_id AS "offset", {K} AS k, n_name AS nation, n_name IS NULL AS miss
        FROM events LEFT JOIN nation ON n_nationkey = {K}""",
    "enrich_as_of_click": f"""
        SELECT cast(o.user_id AS varchar) AS key, o.event_id AS "offset", o.event_type,
               CASE WHEN holds THEN cast(c.event_id AS varchar) END AS click, CASE WHEN holds THEN 'click' END AS props
        FROM (SELECT *, {MS} AS ms FROM events WHERE event_type <> 'click') o
        ASOF LEFT JOIN (SELECT *, {MS} AS ms FROM events WHERE event_type = 'click') c ON o.user_id = c.user_id AND o.ms >= c.ms
        CROSS JOIN LATERAL (SELECT c.value < 20 OR o.ms < c.ms + 21600000 AS holds)""",
    "enrich_in_range": """
        SELECT cast(o_orderkey AS varchar) AS key, o_totalprice AS amount, n_name AS band
        FROM orders LEFT JOIN nation
          ON floor(o_totalprice) >= n_nationkey * 20000 AND floor(o_totalprice) < n_nationkey * 20000 + 15000""",
    "aggregate_by_key": totals("events", USER, DAY),
    "aggregate_group_by": totals("events", "event_type", HOUR),
    "aggregate_lenient_sum": f"""
        SELECT {USER} AS key, cast(0 AS double) AS text, round(sum(value), 2) AS number, cast(0 AS double) AS absent,
               count(*) AS n, {MS} - {MS} % {DAY} AS window_start
        FROM events GROUP BY user_id, window_start""",
    "aggregate_variant": totals("events", USER, DAY, value="cast(json_extract(props, '$.k') AS double)"),
    "aggregate_updates": updates("events", USER, DAY, "event_id"),
    "aggregate_updates_group_by": updates("events", "event_type", 30 * DAY, "event_id"),
    "late_drop_rows": f"""
        SELECT {USER} AS key, event_type, value, arrival AS "offset", {MS} AS ts_ms FROM {SHUFFLED}""",
    "late_drop_aggregate": totals(SHUFFLED, USER, HOUR),
    "late_drop_updates": updates(SHUFFLED, USER, HOUR, "arrival"),
    "join_into_cache_list": PAIR_LISTS,
    "aggregate_into_cache": f"""
        SELECT key, arg_max(n, ts_ms) AS n, arg_max(total, ts_ms) AS total, max(window_start) AS window_start
        FROM ({totals("events", USER, DAY)}) days GROUP BY key""",
    "stream_aggregate_into_cache": f"""
        SELECT key || '@' || window_start AS key, n, total, window_start FROM ({totals("events", USER, DAY)}) days""",
    "stream_join_into_cache_list": PAIR_LISTS,
    "updates_into_aggregate": f"""
        SELECT key, count(*) AS n, round(sum(right_value), 2) AS total, ts_ms - ts_ms % {DAY} AS window_start,
               ts_ms - ts_ms % {DAY} + {DAY} AS window_end, max(ts_ms) AS ts_ms
        FROM ({event_table_join(USER, "(epoch_us(ts) // 1000), event_id")}) joined GROUP BY key, joined.ts_ms - joined.ts_ms % {DAY}""",
    "job_customer_orders_joined": CUSTOMER_ORDERS,
    "job_customer_orders_stats": updates(
        on_time("orders", f"({ORDER_DAYS} // {DAY}) * (1::bigint << 44) + o_orderkey", ORDER_DAYS, 60_000, 5_000),
        "cast(o_custkey AS varchar)",
        60_000,
        "arrival",
        ORDER_DAYS,
        "o_totalprice",
        "\"orderCount\"",
        "\"totalAmount\"",
    ),
    "job_order_stats_complete": totals(
        "orders", "cast(o_custkey AS varchar)", 60_000, ORDER_DAYS, "o_totalprice", "\"orderCount\"", "\"totalAmount\""
    ),
    "stream_job_stats": totals(
        "orders", "cast(o_custkey AS varchar)", 60_000, ORDER_DAYS, "o_totalprice", "\"orderCount\"", "\"totalAmount\""
    ),
    "stream_topic": f"""
        SELECT {USER} AS key, event_type, value, event_id AS "offset" FROM events WHERE value > 50""",
    "stream_aggregate": totals("events", USER, DAY),
    "stream_interval_join": CLICK_OTHER,
    "stream_table_join": CUSTOMER_ORDERS,
    "stream_enrich_merge": f"""
        SELECT event_type AS key, {K} AS k, n_name AS kind, event_id AS at
        FROM events LEFT JOIN nation ON n_nationkey = {K}""",
    "stream_cache_set": LAST_EVENT,
    "stream_cache_list": EVENT_LISTS,
    "stream_fan_out": """
        SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS amount
        FROM orders GROUP BY o_orderstatus""",
    "stream_fan_out_committed": """
        SELECT o_orderstatus AS status, count(*) AS orders, count(*) AS counted FROM orders GROUP BY o_orderstatus""",
    "state_stores": """
        SELECT cast(0 AS bigint) AS operator, 'stateStoreSave' AS "operatorName", 'default' AS "stateStoreName"
        """,
    "state_entries": f"""
        SELECT {USER} AS key, count(*) AS n, cast(0 AS bigint) AS "windowStart",
               cast({36_500 * DAY} AS bigint) AS "windowEnd"
        FROM events GROUP BY user_id""",
}
# The running operators on streams give what the batch operators give over the same records.
ORACLE |= {
    "stream_late_drop": ORACLE["late_drop_rows"],
    "stream_aggregate_updates": ORACLE["aggregate_updates"],
    "stream_late_drop_updates": ORACLE["late_drop_updates"],
    "stream_table_join_updates": ORACLE["table_join_interleaved"],
    "stream_interval_join_waiting": ORACLE["interval_join_events"],
    "stream_list_positions": EVENT_LISTS,
    "stream_list_one_key": f"SELECT * FROM ({EVENT_LISTS}) WHERE key = 'click'",
    "stream_job_joined": ORACLE["job_customer_orders_joined"],
    "stream_job_updates": ORACLE["job_customer_orders_stats"],
}
