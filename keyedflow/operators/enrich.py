"""Enrichment from a lookup table: a left join that takes the first matching row, or the one that holds at the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedflow import rules
from keyedflow.functions.exprs import as_text
from keyedflow.operators.running import running, with_hot_time_chunk
from keyedflow.operators.skew import ROWS_PER_TASK, hot_groups, spread
from keyedflow.sources.envelope import to_millis

BROADCAST_BYTES = 64 * 1024 * 1024
# Allowance per row on top of the text itself when a lookup is held as a hash table.
_ROW_OVERHEAD = 64


def _lookup_rows(lookup: DataFrame, keys: list[str], fields, order_by: Sequence[str]) -> DataFrame:
    """Lookup cut to ``_p0.., _found{target: text}, _order``; a null key matches nothing."""
    found = F.struct(*[F.col(column).cast("string").alias(target) for column, target in fields])
    rows = lookup.select(
        *[F.col(c).cast("string").alias(f"_p{i}") for i, c in enumerate(keys)],
        found.alias("_found"),
        (F.struct(*order_by) if order_by else found).alias("_order"),
    )
    return rows.dropna(subset=[f"_p{i}" for i in range(len(keys))]) if keys else rows


def _text_bytes(rows: DataFrame, params: list[str], targets: list[str]) -> int:
    """Size of all lookup rows, an upper bound for the first rows; one sum, nothing is shuffled."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in [*params, *[f"_found.{t}" for t in targets]]]
    size = sum(texts[1:], texts[0]) + F.lit(_ROW_OVERHEAD)
    return rows.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def _attach(records: DataFrame, first: DataFrame, params: list[str], small: bool, rows_per_task: int | None) -> DataFrame:
    if small:
        return records.join(F.broadcast(first), params, "left")
    if records.isStreaming or rows_per_task is None:
        # Spark splits hot keys at run time, and on a stream it chooses the join for each micro-batch.
        return records.join(first, params, "left")
    # Records of a hot lookup key are spread over splits; its single lookup row is copied to each.
    group = F.xxhash64(*params)
    splits = hot_groups(records, group, rows_per_task).select(
        "_hash", F.ceil(F.col("_rows") / rows_per_task).cast("bigint").alias("_splits")
    )

    def split_counts(df: DataFrame) -> DataFrame:
        joined = df.withColumn("_hash", group).join(F.broadcast(splits), "_hash", "left").drop("_hash")
        return joined.withColumn("_splits", F.coalesce("_splits", F.lit(1).cast("bigint")))

    spread_out = split_counts(records).withColumn("_split", F.pmod(spread(records), "_splits"))
    copies = split_counts(first).withColumn(
        "_split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_splits") - 1))
    )
    return spread_out.drop("_splits").join(copies.drop("_splits"), [*params, "_split"], "left").drop("_split")


def _with_fields(df: DataFrame, found: Column, targets: list[str]) -> Column:
    """``value`` with each target set to the found text, or to null on a miss."""
    if not isinstance(df.schema["value"].dataType, T.VariantType):
        value = F.col("value")
        for t in targets:
            value = value.withField(f"`{t}`", found.getField(t))
        return value
    kept = F.map_filter(F.col("value").cast("map<string,variant>"), lambda k, _: ~k.isin(*targets))
    texts = [F.coalesce(found.getField(t).cast("variant"), F.parse_json(F.lit("null"))) for t in targets]
    added = F.map_from_arrays(F.array(*[F.lit(t) for t in targets]), F.array(*texts))
    return F.to_variant_object(F.map_concat(kept, added))


def enrich_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[tuple[Column | str, str]],
    fields: Sequence[tuple[str, str]],
    order_by: Sequence[str] = (),
    strict: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add columns of the first matching lookup row to ``value``, as text; null when none matches.

    ``on`` pairs an expression over the record with a lookup column; both are compared as
    text. ``fields`` pairs a lookup column with the target field, and replaces a field of
    the same name. The first row is the smallest by ``order_by``, or by the copied columns
    when no order is given. With an empty ``on`` every record gets the first row.

    In batch the lookup is one snapshot. It is broadcast only after its size was measured to
    be at most ``broadcast_bytes``; a larger one is joined by shuffle, where Spark's adaptive
    skew join splits hot keys, or ``rows_per_task`` does by exact counts. On a stream Spark
    decides by its own size limit (``spark.sql.autoBroadcastJoinThreshold``).
    """
    rules.required("lookup", lookup)
    rules.required("fields", list(fields))
    for column, target in fields:
        rules.required("column", column)
        rules.required("target", target)
    # A repeated target keeps the last column given for it.
    fields = list({target: (column, target) for column, target in fields}.values())
    targets = [target for _, target in fields]
    if strict:
        df = df.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
            F.raise_error(F.lit("a null value cannot be enriched")).cast(df.schema["value"].dataType)))
    keys = [column for _, column in on]
    params = [f"_p{i}" for i in range(len(keys))]
    rows, first_row = _lookup_rows(lookup, keys, fields, order_by), F.min_by("_found", "_order").alias("_found")
    if not on:
        attached = df.withColumn("_found", rows.agg(first_row).scalar())
    else:
        records = df.withColumns({p: as_text(df, e, strict) for p, (e, _) in zip(params, on)})
        small = not df.isStreaming and _text_bytes(rows, params, targets) <= broadcast_bytes
        attached = _attach(records, rows.groupBy(*params).agg(first_row), params, small, rows_per_task)
    return attached.withColumn("value", _with_fields(df, F.col("_found"), targets)).select(*df.columns)


def enrich_as_of(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[tuple[Column | str, str]],
    fields: Sequence[tuple[str, str]],
    valid_from: Column | str,
    valid_to: Column | str | None = None,
    at: Column | str = "ts",
    order_by: Sequence[str] = (),
    strict: bool = True,
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """``enrich_lookup`` with rows that hold for a time, or for a range of whole numbers.

    Of the lookup rows with equal keys that start at ``at`` or before, the last to start counts, until
    its ``valid_to`` (exclusive; null or none: for good) or until the next one starts. Of rows that
    start together the first by ``order_by``, or by the copied columns, counts. ``at``, ``valid_from`` and
    ``valid_to`` are timestamps or whole numbers; without ``on``, all records search the same rows, such
    as the bands of a tariff. A null key, time or start matches nothing.

    Lookup rows and records are laid into one sequence per key and the last row carried along it, in
    chunks where a key is hot, so nothing is compared pair by pair and no side has to be small.
    """
    rules.required("lookup", lookup)
    rules.required("fields", list(fields))
    rules.required("valid_from", valid_from)
    rules.batch("enrich_lookup", df)
    rules.ordered(df, ["partition", "offset"])
    for column, target in fields:
        rules.required("column", column)
        rules.required("target", target)
    fields = list({target: (column, target) for column, target in fields}.values())
    targets, params = [t for _, t in fields], [f"_p{i}" for i in range(len(on))]
    keys = [*params, "_any"]
    found = F.struct(*[F.col(c).cast("string").alias(t) for c, t in fields])
    starts = lookup.select(
        *[F.col(c).cast("string").alias(p) for p, (_, c) in zip(params, on)],
        F.lit(0).alias("_any"),
        F.timestamp_millis(to_millis(lookup, valid_from)).alias("ts"),
        F.struct(
            found.alias("found"), (F.lit(None).cast("bigint") if valid_to is None else to_millis(lookup, valid_to)).alias("end")
        ).alias("_row"),
        (F.struct(*order_by) if order_by else found).alias("_order"),
    ).dropna(subset=[*params, "ts"])
    # One row for each start, so that it comes before all records of its time and ties are settled.
    starts = starts.groupBy(*keys, "ts").agg(F.min_by("_row", "_order").alias("_row"))
    starts = starts.withColumns({"partition": F.lit(-(1 << 31)).cast("int"), "offset": F.lit(0).cast("bigint")})
    if strict:
        df = df.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
            F.raise_error(F.lit("a null value cannot be enriched")).cast(df.schema["value"].dataType)))
    records = df.select(
        *[as_text(df, e, strict).alias(p) for p, (e, _) in zip(params, on)],
        F.lit(0).alias("_any"),
        F.timestamp_millis(to_millis(df, at)).alias("ts"),
        F.struct(*df.columns).alias("_record"),
        "partition",
        "offset",
    )
    both = with_hot_time_chunk(records.unionByName(starts, allowMissingColumns=True), keys, rows_per_chunk)
    known = running(both, keys, ["ts", "partition", "offset"], {"_row": "last"}).where(F.col("_record").isNotNull())
    holds = F.col("ts").isNotNull() & (F.col("_row.end").isNull() | (F.unix_millis("ts") < F.col("_row.end")))
    known = known.select("_record.*", F.when(holds, F.col("_row.found")).alias("_found"))
    return known.withColumn("value", _with_fields(df, F.col("_found"), targets)).select(*df.columns)
