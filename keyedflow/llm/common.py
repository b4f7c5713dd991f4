"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyedflow.plans.runs import work_folder

#: White space of all operators here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
WORD = "[^ \\t-\\r]+"

#: Largest table, in bytes as stored, that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` below the folder in ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_kept: dict[object, object] = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """What ``make()`` gives, kept by a Python worker from task to task until one asks for another name, or calls ``let_go``."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """For the start of a task: workers outlive their stage, and with them what an earlier one kept."""
    _kept.clear()


def table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``pos`` long, the rows' place from 0 in the given order, stored.

    Rows are dealt by ranges of the order, so no task gets all of them; only the number of
    rows of each partition meets in one place. Give an order that tells rows apart, and a
    stored ``df``: it is read twice.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id holds the partition's number above the low 33 bits and the row's below.
    placed = store(dealt.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row for each partition, so its size does not follow the data.
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_row")).alias("pos")
    )
