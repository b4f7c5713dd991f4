"""Running folds over arrival order that never sort a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(arrival)`` puts every row of a key into one
task. Here the rows of a key are cut into consecutive chunks. Each chunk is first folded
to one total (aggregated before the shuffle), a window over those few totals gives what
each chunk starts from, and that carry enters the chunk as one extra leading row. The
rows themselves are shuffled once, by ``(key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyedflow.operators.skew import hot_groups
from keyedflow.plans.runs import work_folder

CHUNK, _IS_ROW = "_chunk", "_is_row"
#: Hot groups that the driver holds at most; a row of them is a few numbers.
KEPT_GROUPS = 10_000


def offset_chunk(rows_per_chunk: int) -> Column:
    """Chunk of a record by arrival: at most ``rows_per_chunk`` rows, as offsets are unique."""
    offset = F.col("offset")
    return F.struct(F.col("partition"), (offset - F.pmod(offset, F.lit(rows_per_chunk))).alias("first"))


def _group(*columns: str) -> Column:
    """Hash of ``columns``. The offset has no part in it, but keeps Spark from folding the hash of constant
    columns, which would turn a join on it into one without a key.
    """
    return F.xxhash64(*columns).bitwiseXOR(F.col("offset").bitwiseAND(F.lit(0).cast("bigint")))


def _found(groups: DataFrame) -> DataFrame | None:
    """The hot groups, found once and for all; None when there are none.

    A few are held by the driver and broadcast. More of them are written to the shared folder, and
    Spark joins them by their size.
    """
    rows = groups.limit(KEPT_GROUPS + 1).collect()
    if not rows:
        return None
    if len(rows) <= KEPT_GROUPS:
        return F.broadcast(groups.sparkSession.createDataFrame(rows, groups.schema))
    folder = work_folder(groups.sparkSession)
    groups.write.parquet(folder)
    return groups.sparkSession.read.schema(groups.schema).parquet(folder)


def _binned(df: DataFrame, groups: Column, position: Column, name: str, rows_per_chunk: int) -> DataFrame | None:
    """``df`` with the bin of each row of a hot group as column ``name``, null in other groups; None without hot groups.

    The span of ``position`` in a hot group is cut into as many equal bins as it has chunks
    of rows (times four, to leave room for uneven spans), so bins follow the number of rows,
    however far apart their positions are.
    """
    hot = hot_groups(df.where(groups.isNotNull()), groups, rows_per_chunk, {"_lo": F.min(position), "_hi": F.max(position)})
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(4 * F.col("_rows") / rows_per_chunk))
    spans = _found(hot.select(F.col("_hash").alias("_group"), F.col("_lo"), width.cast("bigint").alias("_width")))
    if spans is None:
        return None
    placed = df.withColumn("_group", groups).join(spans, "_group", "left")
    at = placed.withColumn("_at", position).withColumn(name, F.expr("(_at - _lo) div _width"))
    return at.drop("_group", "_lo", "_width", "_at")


def _bin_group(keys: Sequence[str], *bins: str) -> Column:
    """Group of the rows of a key's bin; null, which is never hot, outside of hot groups."""
    return F.when(F.col(bins[-1]).isNotNull(), _group(*keys, *bins))


def _crowded(df: DataFrame, groups: Column, rows_per_chunk: int) -> DataFrame:
    """``df`` with ``_crowded`` true in groups that are still too large for a chunk."""
    full = _found(hot_groups(df.where(groups.isNotNull()), groups, rows_per_chunk).select(F.col("_hash").alias("_group"), F.lit(True).alias("_crowded")))
    if full is None:
        return df.withColumn("_crowded", F.lit(False))
    return df.withColumn("_group", groups).join(full, "_group", "left").drop("_group")


def with_hot_offset_chunk(df: DataFrame, keys: Sequence[str], rows_per_chunk: int) -> DataFrame:
    """Chunks in arrival order for hot keys only; a key that is not hot stays whole (null chunk).

    Without hot keys ``df`` comes back as it is. Keys are counted here and now, in one pass; bins only
    of hot keys. A bin that gaps in the offsets leave too full is cut further, by offset alone.
    """
    binned = _binned(df, _group(*keys), F.col("offset"), "_bin", rows_per_chunk)
    if binned is None:
        return df
    marked = _crowded(binned, _bin_group(keys, "partition", "_bin"), rows_per_chunk)
    fine = F.when(F.col("_crowded"), offset_chunk(rows_per_chunk))
    chunk = F.when(F.col("_bin").isNotNull(), F.struct("partition", "_bin", fine.alias("fine")))
    return marked.withColumn(CHUNK, chunk).drop("_bin", "_crowded")


def with_hot_time_chunk(df: DataFrame, keys: Sequence[str], rows_per_chunk: int) -> DataFrame:
    """Chunks that follow ``(ts, partition, offset)`` order, for hot keys only, as above.

    A bin of time that is too full, such as a burst or a backfill, is cut by time again; what
    is then still too full, such as rows with one timestamp, is cut by exact time and offset.
    """
    ms = F.unix_millis("ts")
    coarse = _binned(df, _group(*keys), ms, "_bin", rows_per_chunk)
    if coarse is None:
        return df
    binned = _binned(coarse, _bin_group(keys, "_bin"), ms, "_fine_bin", rows_per_chunk)
    if binned is None:
        return coarse.withColumn(CHUNK, F.when(F.col("_bin").isNotNull(), F.struct("_bin"))).drop("_bin")
    marked = _crowded(binned, _bin_group(keys, "_bin", "_fine_bin"), rows_per_chunk)
    fine = F.when(F.col("_crowded"), F.struct("ts", offset_chunk(rows_per_chunk).alias("arrival")))
    chunk = F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_fine_bin", fine.alias("fine")))
    return marked.withColumn(CHUNK, chunk).drop("_bin", "_fine_bin", "_crowded")


def _total(kind: str, name: str, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(name)
    if kind == "max":
        return F.max(name)
    if kind == "last":
        # max_by skips rows whose order is null, here those without a value.
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order)))
    raise ValueError(f"unknown fold {kind!r}")


def _fold(kind: str, name: str) -> Column:
    return F.last(name, ignorenulls=True) if kind == "last" else {"sum": F.sum, "max": F.max}[kind](name)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, str]) -> DataFrame:
    """Replace each column in ``folds`` by its fold (sum, max, last) up to and including the row.

    ``df`` must come from one of the functions above with the same ``order``, which must be unique
    within a key. Where that found no hot key, the fold is one window.
    """
    if CHUNK not in df.columns:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: _fold(kind, name).over(upto) for name, kind in folds.items()})
    totals = (
        df.where(F.col(CHUNK).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(*[_total(kind, name, order).alias(name) for name, kind in folds.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, CHUNK, *[_fold(kind, name).over(earlier).alias(name) for name, kind in folds.items()]
    ).where(reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in folds]))
    rows = df.withColumn(_IS_ROW, F.lit(1)).unionByName(
        carry.withColumn(_IS_ROW, F.lit(0)), allowMissingColumns=True
    )
    upto = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(_IS_ROW, *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    folded = rows.withColumns({name: _fold(kind, name).over(upto) for name, kind in folds.items()})
    return folded.where(F.col(_IS_ROW) == 1).drop(_IS_ROW, CHUNK)
