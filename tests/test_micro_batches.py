"""Streaming queries give the same rows however their tables are cut into micro-batches."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from check import connect, difference
from keyedflow.plans import runs
from keyedflow.plans.catalogue import QUERIES
from keyedflow.plans.oracle import ORACLE
from keyedflow.sources.topics import bounded_stream

STREAMED = sorted(q for q in QUERIES if q.startswith("stream_"))
TABLES = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey"}


@pytest.fixture(scope="module")
def cut(spark, sf_dir):
    """The tables with their rows at random over three files each."""
    folder = tempfile.mkdtemp(prefix="keyedflow-cut-")
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        if table in TABLES:
            rows = spark.read.parquet(f"{sf_dir}/{name}").withColumn("_file", F.pmod(F.xxhash64(TABLES[table], F.lit(7)), F.lit(3)))
            for i in (2, 0, 1):
                rows.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        elif name.endswith(".parquet"):
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    return folder


@pytest.mark.parametrize("name", STREAMED)
def test_one_file_a_micro_batch(spark, sf_dir, cut, monkeypatch, name):
    monkeypatch.setattr(runs, "bounded_stream", lambda session: bounded_stream(session, 1))
    assert difference(QUERIES[name](spark, cut), connect(sf_dir), ORACLE[name]) is None
