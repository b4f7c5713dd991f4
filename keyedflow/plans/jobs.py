"""Composed jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keyedflow.operators.aggregates import Count, Sum, window_aggregate, window_aggregate_changelog
from keyedflow.operators.joins import table_join_changelog
from keyedflow.streaming.aggregates import window_aggregate_stream
from keyedflow.streaming.joins import table_join_stream
from keyedflow.streaming.running import table_join_changes_stream, window_changelog_stream

ORDER_STATS = (Count("orderCount"), Sum("amount", "totalAmount"))
STATS_WINDOW_MS = 60_000
STATS_GRACE_MS = 5_000


class CustomerOrders(NamedTuple):
    joined: DataFrame
    stats: DataFrame


def order_stats(orders: DataFrame, grace: int | None = STATS_GRACE_MS) -> DataFrame:
    """Orders and amount per customer and minute, one final row each."""
    return window_aggregate(
        orders, ORDER_STATS, STATS_WINDOW_MS, grace, group_mode="GROUP_BY", key_extractor="value.customerId"
    )


def customer_orders(customers: DataFrame, orders: DataFrame) -> CustomerOrders:
    """Customers joined to their orders on ``customerId``, and order statistics, both as changelogs."""
    joined = table_join_changelog(customers, orders, "customer", "order", "value.customerId")
    stats = window_aggregate_changelog(
        orders,
        ORDER_STATS,
        STATS_WINDOW_MS,
        STATS_GRACE_MS,
        group_mode="GROUP_BY",
        key_extractor="value.customerId",
    )
    return CustomerOrders(joined, stats)


def customer_orders_stream(customers: DataFrame, orders: DataFrame, grace: int = STATS_GRACE_MS) -> CustomerOrders:
    """``customer_orders`` on streams; write ``joined`` in append and ``stats`` in update mode.

    Give a ``grace`` that covers the data when files of a backfill come in any time order.
    """
    joined = table_join_stream(customers, orders, "customer", "order", "value.customerId")
    stats = window_aggregate_stream(
        orders,
        ORDER_STATS,
        STATS_WINDOW_MS,
        grace,
        group_mode="GROUP_BY",
        key_extractor="value.customerId",
    )
    return CustomerOrders(joined, stats)


class CustomerOrdersWriters(NamedTuple):
    joined: DataStreamWriter
    stats: DataStreamWriter


def customer_orders_changes(
    customers: DataFrame, orders: DataFrame, folder: str, checkpoint: str, grace: int | None = STATS_GRACE_MS
) -> CustomerOrdersWriters:
    """``customer_orders`` on streams with every update of both, read with ``read_steps`` from ``joined`` and ``stats``."""
    joined = table_join_changes_stream(
        customers, orders, "customer", "order", "value.customerId", f"{folder}/joined", f"{checkpoint}/joined"
    )
    stats = window_changelog_stream(
        orders,
        ORDER_STATS,
        STATS_WINDOW_MS,
        f"{folder}/stats",
        f"{checkpoint}/stats",
        grace,
        group_mode="GROUP_BY",
        key_extractor="value.customerId",
    )
    return CustomerOrdersWriters(joined, stats)
