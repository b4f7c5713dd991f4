"""Argument rules shared by the operators; every violation is a ValueError."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

MAX_JOIN_WINDOW_MS = 10 * 60 * 1000
MAX_JOIN_GRACE_MS = 30 * 1000


def required(name: str, value) -> None:
    """Reject None, blank strings and empty sequences."""
    if value is None:
        raise ValueError(f"{name} is required")
    if isinstance(value, str) and not value.strip():
        raise ValueError(f"{name} must not be blank")
    if isinstance(value, (list, tuple, dict)) and not value:
        raise ValueError(f"{name} must not be empty")


def millis(name: str, value: int | timedelta | None) -> int:
    """A duration given as whole milliseconds or as a timedelta."""
    if value is None:
        raise ValueError(f"{name} is required")
    if isinstance(value, timedelta):
        # Round a sub-millisecond remainder up, so that a positive duration stays positive.
        return -(-value // timedelta(milliseconds=1))
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be whole milliseconds or a timedelta, got {value!r}")
    return value


def join_window(value: int | timedelta | None) -> int:
    ms = millis("window", value)
    if not 0 < ms <= MAX_JOIN_WINDOW_MS:
        raise ValueError(f"window must be above 0 and at most 10 minutes, got {ms} ms")
    return ms


def join_grace(value: int | timedelta | None) -> int:
    ms = millis("grace", value)
    if not 0 <= ms <= MAX_JOIN_GRACE_MS:
        raise ValueError(f"grace must be between 0 and 30 seconds, got {ms} ms")
    return ms


def disorder(value: int | timedelta) -> int:
    ms = millis("disorder", value)
    if ms < 0:
        raise ValueError(f"disorder must not be negative, got {ms} ms")
    return ms


def join_sides(left_name: str, right_name: str, select_key, join_type: str | None) -> None:
    required("left_name", left_name)
    required("right_name", right_name)
    if left_name == right_name:
        raise ValueError(f"left_name and right_name must differ, both are {left_name!r}")
    required("select_key", select_key)
    if join_type is None or join_type.upper() != "INNER":
        raise ValueError(f"only INNER joins are supported, got {join_type!r}")


def window_size(value: int | timedelta | None, window_type: str | None) -> int:
    if window_type is None or window_type.upper() != "TUMBLING":
        raise ValueError(f"only TUMBLING windows are supported, got {window_type!r}")
    ms = millis("size", value)
    if ms <= 0:
        raise ValueError(f"window size must be above 0, got {ms} ms")
    return ms


def window_grace(value: int | timedelta) -> int:
    ms = millis("grace", value)
    if ms < 0:
        raise ValueError(f"grace must not be negative, got {ms} ms")
    return ms


def aggregations(aggs: Sequence) -> None:
    if not aggs:
        raise ValueError("at least one aggregation is required")
    aliases = [a.alias for a in aggs]
    if len(set(aliases)) != len(aliases):
        raise ValueError(f"aggregation aliases must be unique, got {aliases}")


def ordered(df, order: Sequence[str]) -> None:
    """Operators that depend on arrival need the columns that tell it."""
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ValueError(f"arrival order needs the columns {missing}; write join results with land() to get them")


def batch(stream_form: str, *inputs) -> None:
    """Operators over complete tables name their streaming form when given a stream."""
    if any(df.isStreaming for df in inputs):
        raise ValueError(f"this operator reads complete tables; for streams use {stream_form}")
