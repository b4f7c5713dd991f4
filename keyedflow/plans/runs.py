"""Running a streaming plan over the data available now, as tests and the query catalogue do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyedflow.sources.topics import bounded_stream


def work_folder(spark: SparkSession) -> str:
    """New folder below the shared one named by ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; a cluster has no folder
    that all executors see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/keyedflow-{uuid.uuid4()}"


def run_to_end(writer: DataStreamWriter) -> None:
    """Process everything available, then stop; an error in the query is raised here."""
    writer.trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A benchmark table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # A glob, since a file stream takes folders or patterns but not one plain file.
    return bounded_stream(spark).schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def run_in_parts(df: DataFrame, order: str, parts: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Hand the rows of ``df`` to a stream in consecutive ``parts`` by ``order``, a number.

    ``start`` makes the writer from the stream. It is started anew for every part, from its checkpoint,
    and takes the part as one micro-batch.
    """
    spark, folder = df.sparkSession, f"{work_folder(df.sparkSession)}/parts"
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        above = F.lit(True) if low is None else F.col(order) > low
        below = F.lit(True) if high is None else F.col(order) <= high
        df.where(above & below).write.mode("append").parquet(folder)
        run_to_end(start(spark.readStream.schema(df.schema).parquet(folder)))
