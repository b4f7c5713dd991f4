"""Streaming forms of the joins."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyedflow import rules
from keyedflow.functions.exprs import all_of, as_text
from keyedflow.operators.joins import joined_value, paired_arrivals, record, tagged_arrivals
from keyedflow.operators.skew import ROWS_PER_TASK


def interval_join_stream(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    window: int | timedelta,
    grace: int | timedelta,
    join_type: str | None = "INNER",
    strict: bool = True,
    salts: int = 1,
    disorder: int | timedelta = 0,
) -> DataFrame:
    """``interval_join`` on two streams, in append mode; ``grace`` becomes the watermark delay.

    ``disorder`` is added to the delay: how far a source hands its records out of time order,
    such as files of a backfill that are read in any order. With one that covers the data, the
    pairs don't depend on how it is cut into micro-batches.

    ``salts`` above 1 spreads every key over that many state partitions: left records go to
    one of them, right records to all. Put the busier stream on the left.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    window_ms, delay_ms = rules.join_window(window), rules.join_grace(grace) + rules.disorder(disorder)
    if salts < 1:
        raise ValueError(f"salts must be at least 1, got {salts}")
    left_salt = F.pmod(F.xxhash64("partition", "offset"), F.lit(salts)).cast("int")
    right_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0)

    def side(df: DataFrame, name: str, salt: Column) -> DataFrame:
        return df.withWatermark("ts", f"{delay_ms} milliseconds").select(
            as_text(df, select_key, strict).alias(f"{name}_key"),
            record().alias(f"{name}_record"),
            F.col("ts").alias(f"{name}_ts"),
            salt.alias(f"{name}_salt"),
        )

    reach = F.expr(f"INTERVAL '{window_ms / 1000:.3f}' SECOND")
    pairs = side(left, "l", left_salt).join(
        side(right, "r", right_salt),
        all_of(
            [
                F.col("l_key") == F.col("r_key"),
                F.col("l_salt") == F.col("r_salt"),
                F.col("r_ts") >= F.col("l_ts") - reach,
                F.col("r_ts") <= F.col("l_ts") + reach,
            ]
        ),
    )
    return pairs.select(
        F.col("l_key").alias("key"),
        joined_value(left_name, F.col("l_record"), right_name, F.col("r_record")).alias("value"),
        F.greatest("l_ts", "r_ts").alias("ts"),
    )


_ORDER = {"ts": ["ms", "partition", "offset", "side"], "offset": ["partition", "offset", "side"]}
_RECORD = ["record_key", "record_value", "ms"]
# The latest record of each side; ms is null while a side has none.
_STATE = "l_key STRING, l_value STRING, l_ms BIGINT, r_key STRING, r_value STRING, r_ms BIGINT"
_PAIRS = f"key STRING, partition INT, offset BIGINT, {_STATE}"


def _pair_arrivals(order: list[str]):
    """State function of ``table_join_stream``.

    It refers to nothing but pandas, numpy and constants, so that Python workers can load
    it without this package installed.
    """

    sort_keys, fields = order[::-1], [*_RECORD, "side"]

    def pair(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        arrived = {c: rows[c].to_numpy() for c in rows.columns}
        in_order = np.lexsort([arrived[c] for c in sort_keys])
        arrived = {c: values[in_order] for c, values in arrived.items()}

        # The latest records from earlier micro-batches go first, as if they arrived again.
        held = state.get if state.exists else (None,) * 6
        known = [(*held[3 * s : 3 * s + 3], s) for s in (0, 1) if held[3 * s + 2] is not None]
        both = {
            c: np.concatenate([np.array([k[i] for k in known], dtype=arrived[c].dtype), arrived[c]])
            for i, c in enumerate(fields)
        }
        at = np.arange(len(both["side"]))
        latest = [np.maximum.accumulate(np.where(both["side"] == s, at, -1)) for s in (0, 1)]
        state.update(
            tuple(
                None if pos[-1] < 0 else int(both[c][pos[-1]]) if c == "ms" else both[c][pos[-1]]
                for pos in latest
                for c in _RECORD
            )
        )
        emit = np.flatnonzero((latest[0] >= 0) & (latest[1] >= 0) & (at >= len(known)))
        if not len(emit):
            return
        new = emit - len(known)
        yield pd.DataFrame(
            {
                "key": key[0],
                "partition": arrived["partition"][new],
                "offset": arrived["offset"][new] * 2 + arrived["side"][new],
                **{f"{name}_{c.removeprefix('record_')}": both[c][pos[emit]] for name, pos in zip("lr", latest) for c in _RECORD},
            }
        )

    return pair


def table_join_stream(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    select_key: Column | str,
    join_type: str | None = "INNER",
    strict: bool = True,
    order_by: str = "ts",
) -> DataFrame:
    """``table_join_changelog`` on two streams, in append mode.

    State is the latest record of each side per key and never expires; use the RocksDB
    state store. Records arrive by micro-batch and, within one, in ``order_by`` order. The
    rows of a key in one micro-batch are held by one task, so the sources must bound their
    micro-batches (``maxOffsetsPerTrigger`` and the like, which ``read_topic`` sets).

    What pairs with what follows from when records arrive, as it does in any running table
    join. ``table_join_log`` gives the same rows however the input is cut.
    """
    rules.join_sides(left_name, right_name, select_key, join_type)
    if order_by not in _ORDER:
        raise ValueError(f"order_by must be 'ts' or 'offset', got {order_by!r}")
    arrivals = tagged_arrivals(left, right, select_key, strict)
    json = {"ignoreNullFields": "false"}
    rows = arrivals.select(
        "key",
        F.unix_millis("ts").alias("ms"),
        "partition",
        "offset",
        "side",
        F.coalesce("_left.record.key", "_right.record.key").alias("record_key"),
        F.coalesce(F.to_json("_left.record.value", json), F.to_json("_right.record.value", json)).alias(
            "record_value"
        ),
    )
    pairs = rows.groupBy("key").applyInPandasWithState(
        _pair_arrivals(_ORDER[order_by]), _PAIRS, _STATE, "append", GroupStateTimeout.NoTimeout
    )

    def side(prefix: str, df: DataFrame) -> Column:
        dtype, text = df.schema["value"].dataType, F.col(f"{prefix}_value")
        value = F.parse_json(text) if isinstance(dtype, T.VariantType) else F.from_json(text, dtype)
        return F.struct(F.col(f"{prefix}_key").alias("key"), value.alias("value"))

    return pairs.select(
        "key",
        joined_value(left_name, side("l", left), right_name, side("r", right)).alias("value"),
        F.timestamp_millis(F.greatest("l_ms", "r_ms")).alias("ts"),
        "partition",
        "offset",
    )


def table_join_log(
    left: DataFrame,
    right: DataFrame,
    select_key: Column | str,
    folder: str,
    checkpoint: str,
    strict: bool = True,
) -> DataStreamWriter:
    """Store the arrivals of both streams, keyed for the join; read them with ``read_table_join``.

    Nothing is held in state or sorted, and the file sink commits each micro-batch once, so
    what is read depends on the records alone, not on the micro-batches they came in.
    """
    rules.required("select_key", select_key)
    rules.required("folder", folder)
    writer = tagged_arrivals(left, right, select_key, strict).writeStream.format("parquet").option("path", folder)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def read_table_join(
    spark: SparkSession,
    folder: str,
    left_name: str,
    right_name: str,
    order_by: str = "ts",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """The changelog of a ``table_join_log`` so far, with hot keys split as in ``table_join_changelog``."""
    rules.join_sides(left_name, right_name, "key", "INNER")
    return paired_arrivals(spark.read.parquet(folder), left_name, right_name, order_by, rows_per_chunk)
