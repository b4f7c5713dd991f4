"""State that micro-batches keep as a table: rows by key, in buckets, a new version of a bucket per batch.

A micro-batch reads the newest version, older than itself, of the buckets that its keys fall into, and
writes new versions of these. No other bucket is read or written, and each holds one row per key, so
a batch costs what its buckets hold, however many batches came before. The index of a batch, a small
file written last, names the version of every bucket. A batch that is replayed reads what it read the
first time and overwrites what it wrote, so nothing is added twice; versions that neither the newest index
nor the one before names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedflow import rules

BUCKETS = 32


@dataclass(frozen=True)
class BucketTable:
    """One row for each value of ``keys`` below ``folder``; the number of buckets stays as it is once written."""

    folder: str
    keys: Sequence[str]
    buckets: int = BUCKETS

    def __post_init__(self):
        rules.required("folder", self.folder)
        rules.required("keys", list(self.keys))
        if self.buckets < 1:
            raise ValueError(f"buckets must be at least 1, got {self.buckets}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, path = self._files(spark)
        at = path(f"{self.folder}/{folder}")
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _indexes(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(spark, "index") if n.endswith(".json"))

    def _index(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Version of every bucket after the last batch, or after the last one before ``before``."""
        known = [i for i in self._indexes(spark) if before is None or i < before]
        if not known:
            return {}
        text = spark.read.text(f"{self.folder}/index/{known[-1]}.json", wholetext=True).first()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, spark: SparkSession, index: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.folder}/rows/batch_id={v}/bucket={b}" for b, v in sorted(index.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def before(self, spark: SparkSession, batch_id: int, touched: Sequence[int], schema: T.StructType) -> DataFrame:
        """Rows of the buckets ``touched`` as they were before the batch."""
        index = self._index(spark, batch_id)
        return self._read(spark, {b: index[b] for b in touched if b in index}, schema)

    def write(self, rows: DataFrame, batch_id: int, touched: Sequence[int]) -> None:
        """Replace the buckets ``touched`` by ``rows``, which are all rows that they hold from now on."""
        spark = rows.sparkSession
        index = self._index(spark, batch_id)
        placed = rows.withColumn("bucket", self.bucket()).repartition(max(len(touched), 1), "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/batch_id={batch_id}")
        held = {int(n.partition("=")[2]) for n in self._names(spark, f"rows/batch_id={batch_id}") if n.startswith("bucket=")}
        after = {b: v for b, v in index.items() if b not in touched} | {b: batch_id for b in held}
        self._commit(spark, batch_id, after, index)

    def _commit(self, spark: SparkSession, batch_id: int, after: dict[int, int], before: dict[int, int]) -> None:
        files, path = self._files(spark)
        part, done = path(f"{self.folder}/index/{batch_id}.part"), path(f"{self.folder}/index/{batch_id}.json")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(after), "utf-8"))
        out.close()
        files.delete(done, False)
        files.rename(part, done)
        for old in self._indexes(spark)[:-2]:
            files.delete(path(f"{self.folder}/index/{old}.json"), False)
        used = set(after.items()) | set(before.items())
        for name in self._names(spark, "rows"):
            version = int(name.partition("=")[2])
            if version >= batch_id:
                continue
            buckets = [n for n in self._names(spark, f"rows/{name}") if n.startswith("bucket=")]
            stale = [n for n in buckets if (int(n.partition("=")[2]), version) not in used]
            for n in [None] if len(stale) == len(buckets) else stale:
                files.delete(path(f"{self.folder}/rows/{name}" + (f"/{n}" if n else "")), True)

    def current(self, spark: SparkSession) -> DataFrame:
        """All rows after the last batch."""
        index = self._index(spark)
        if not index:
            raise ValueError(f"no batch has been written below {self.folder}")
        paths = [f"{self.folder}/rows/batch_id={v}/bucket={b}" for b, v in sorted(index.items())]
        return spark.read.parquet(*paths)
