"""Small fixtures: envelopes from Python rows, and their results as plain tuples."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from keyedflow import decode

RAW = "key STRING, value STRING, timestamp TIMESTAMP, partition INT, offset BIGINT"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def raw(spark, rows):
    """Raw topic rows from ``(key, value, ms[, offset[, partition]])``; value is an object or None."""
    out = []
    for i, (key, value, ms, *rest) in enumerate(rows):
        text = None if value is None else json.dumps(value)
        out.append((key, text, at(ms), rest[1] if len(rest) > 1 else 0, rest[0] if rest else i))
    return spark.createDataFrame(out, RAW)


def envelope(spark, rows, schema=None):
    """VARIANT envelope, or a typed one when a value ``schema`` is given."""
    return decode(raw(spark, rows), schema)


def records(df, *order):
    """Rows as ``(key, value object, ts in ms)``."""
    df = df.orderBy(*order) if order else df
    rows = df.select(
        "key", F.to_json("value", {"ignoreNullFields": "false"}).alias("v"), F.unix_millis("ts").alias("ms")
    ).collect()
    return [(r.key, None if r.v is None else json.loads(r.v), r.ms) for r in rows]
