"""Stateless operators: mapping, filter, rekey, merge and key placement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow import rules
from keyedflow.functions.exprs import as_bool, as_node, as_text

FROM_KEY = object()
"""Marks a mapping field that takes the record key."""


def mapping(df: DataFrame, fields: Sequence[tuple[str, object]], strict: bool = True) -> DataFrame:
    """Replace ``value`` by a struct of ``(target, source)`` fields; the key stays.

    A source is a Column, a Spark SQL string or ``FROM_KEY``. When a target repeats,
    the last one wins but keeps the first one's position.
    """
    rules.required("fields", list(fields))
    chosen: dict[str, Column] = {}
    for target, source in fields:
        rules.required("target", target)
        rules.required(f"source of {target}", source)
        column = F.col("key") if source is FROM_KEY else as_node(df, source, strict)
        chosen[target] = column.alias(target)
    return df.withColumn("value", F.struct(*chosen.values()))


def filter_(df: DataFrame, predicate: Column | str, strict: bool = True) -> DataFrame:
    """Keep records whose predicate is true; a null predicate raises.

    ``strict=False`` drops nulls instead. Either way Spark can push the predicate into the
    scan: what is surely false goes first, and only the rest is checked for nulls.
    """
    rules.required("predicate", predicate)
    if strict:
        flag = as_bool(df, predicate, strict=False)
        df = df.filter(flag | flag.isNull())
    return df.filter(as_bool(df, predicate, strict))


def rekey(df: DataFrame, select_key: Column | str, strict: bool = True) -> DataFrame:
    """Replace the key by the text of an expression; null or missing raises."""
    rules.required("select_key", select_key)
    return df.withColumn("key", as_text(df, select_key, strict))


def merge(*inputs: DataFrame, separate: bool = False) -> DataFrame:
    """Union of all inputs with duplicates kept and no order between them.

    Branches of one source keep their common arrival order. Different topics number their
    partitions alike; ``separate=True`` renumbers them, so that ``(partition, offset)``
    stays unique for operators that depend on it.
    """
    rules.required("inputs", inputs)
    if separate:
        inputs = tuple(
            df.withColumn("partition", F.col("partition") * len(inputs) + i) for i, df in enumerate(inputs)
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def key_partition(partitions: int, key: Column | str = "key") -> Column:
    """Partition number of a key, the one Spark's hash exchange gives for ``partitions``."""
    if partitions <= 0:
        raise ValueError(f"partitions must be above 0, got {partitions}")
    return F.pmod(F.hash(key), F.lit(partitions)).cast("int")


def colocate(df: DataFrame, partitions: int) -> DataFrame:
    """Move all records of a key to the one Spark partition ``key_partition`` names.

    Keyed operators here place rows themselves and split hot keys while doing so; this is
    only for callers who need the placement itself, such as a sink that writes per partition.
    """
    if partitions <= 0:
        raise ValueError(f"partitions must be above 0, got {partitions}")
    return df.repartition(partitions, "key")
