"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Three passes over the vectors. One sums the entries, exactly. One centres the rows and reduces them to a
triangular factor R, block by block within a task and then ``FAN`` factors at a time in rounds, so that
nothing but R reaches the driver: a square of the number of dimensions. R'R is the covariance
times n, but it is never formed: R is made bidiagonal by Householder reflections, dqds finds the
singular values and twisted factorisations their directions (``bidiagonal``). The last pass
projects every row; the covariance of what it gives is summed and held against the identity.

Defined results: rows whose vector is null or has a null, NaN or infinite entry are left out. Vectors
shorter than the longest end in zeros. Entries beyond 2**52 / 64 in size count as that. Directions
without variance (fewer vectors than dimensions, constant entries) have whitened 0.0 and explained 0.0
and no part in identity_error. deviation is null where it doesn't fit a long. Null and repeated ids get rows
like all others. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.bidiagonal import EPS, right_singular
from keyedflow.llm.common import store, table

COMPONENTS = 32
#: Triangular factors that one task reduces to one.
FAN = 16
SHIFT, SCALE, LARGEST = 1_000_000, 64, 2.0**52


class Moments(NamedTuple):
    n: int
    sums: list[int]


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, vector`` of the rows that take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def whole(batch: pa.RecordBatch, size: int | None = None) -> np.ndarray:
    """The entries of a batch as whole numbers less ``SHIFT``, a row each."""
    column = batch.column("vector")
    lengths = np.asarray(column.value_lengths())
    size = int(lengths.max(initial=0)) if size is None else size
    flat = np.floor(np.clip(np.asarray(column.flatten()) * SCALE, -LARGEST, LARGEST)).astype(np.int64)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def moments(rows: DataFrame) -> Moments:
    """Number of vectors and exact sums of x, a number for each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch)
            if len(x):
                # Halves of the numbers, so that a batch can't overflow.
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                sums = [str((h << 26) + w) for h, w in zip(high, low)]
                yield pa.RecordBatch.from_pydict({"at": pa.array([*range(len(sums)), -1], pa.int32()), "total": [*sums, str(len(x))]})

    parts = rows.mapInArrow(partial, "at int, total string")
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = found.pop(-1, 0)
    return Moments(n, [found[i] + SHIFT * n for i in range(len(found))])


def _centre(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Whole part of the mean less SHIFT, and what is left of the sum."""
    parts = [divmod(s - SHIFT * m.n, m.n) for s in m.sums]
    return np.array([q for q, _ in parts], np.int64), np.array([r for _, r in parts], np.int64)


def centred(x: np.ndarray, m: Moments, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x - S/n with a single rounding or two."""
    return (x - centre[0]).astype(float) - centre[1] / m.n


def deviations(x: np.ndarray, m: Moments, centre: tuple[np.ndarray, np.ndarray]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2; None where it is beyond a long."""
    away = x - centre[0]
    most = int(np.abs(away).max(initial=0)) + 1
    if x.shape[1] * (m.n * most) ** 2 < 2**63:
        return ((m.n * away - centre[1]) ** 2).sum(axis=1).tolist()
    exact = [sum((m.n * int(v) - int(r)) ** 2 for v, r in zip(row, centre[1])) for row in away]
    return [e if e < 2**63 else None for e in exact]


def _factor(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def triangle(rows: DataFrame, m: Moments, fan: int = FAN) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    size, centre = len(m.sums), _centre(m)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            x = centred(whole(batch, size), m, centre)
            for at in range(0, len(x), 4 * size):
                r = _factor([r, x[at : at + 4 * size]])
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()] * len(r), pa.int64()), "row": r.tolist()})

    def merge(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r = _factor([np.zeros((0, size)), np.array(t.column("row").to_pylist())])
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // fan] * len(r), pa.int64()), "row": pa.array(r.tolist(), pa.list_(pa.float64()))})

    schema = "part long, row array<double>"
    factors = store(rows.mapInArrow(reduce, schema))
    parts = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > fan:
        factors = store(factors.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, schema))
        parts = -(-parts // fan)
    # At most FAN triangles.
    last = [r["row"] for r in factors.orderBy("part", "row").collect()]
    r = _factor([np.zeros((size, size)), np.array(last).reshape(-1, size)])
    return r[:size]


class Directions(NamedTuple):
    axes: np.ndarray
    explained: list[float]


def directions(r: np.ndarray, n: int, components: int = COMPONENTS) -> Directions:
    """Whitening directions, a column each, with zeros for those without variance."""
    values, vectors = right_singular(r, components)
    none = values <= (8 * len(r) * EPS) ** 2 * values.max(initial=0.0)
    spread = np.sqrt(np.where(none, 1.0, values / n))
    total = float((r * r).sum()) or 1.0
    return Directions(np.where(none, 0.0, vectors / spread), np.where(none, 0.0, values / total).tolist())


def projected(rows: DataFrame, m: Moments, found: Directions) -> DataFrame:
    """``id, deviation, whitened`` (an array) of every row."""
    size, centre, axes = len(m.sums), _centre(m), found.axes
    id_type = rows.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch, size)
            out = centred(x, m, centre) @ axes
            flat = pa.array(out.ravel())
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(deviations(x, m, centre), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "deviation", "whitened"],
            )

    return rows.mapInArrow(project, f"id {id_type}, deviation long, whitened array<double>")


def identity_error(done: DataFrame, found: Directions, n: int) -> float:
    """Largest entry of the covariance of ``whitened`` less the identity, over components with variance."""
    k = len(found.explained)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = np.asarray(batch.column("whitened").flatten()).reshape(-1, k)
            sums += w.sum(axis=0)
            products += w.T @ w
        both = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(both), dtype=np.int32)), "total": both})

    parts = done.select("whitened").mapInArrow(partial, "at int, total double")
    rows = parts.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    flat = np.array([r["total"] for r in rows])
    # The rows are centred up to rounding; what is left of their mean is taken off here.
    mean, has = flat[:k] / n, np.array(found.explained) > 0
    left = flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(left[has][:, has]).max(initial=0.0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component."""
    rows = valid(df, id_col, vector_col)
    m = moments(rows)
    if m.n == 0 or not m.sums:
        return _listed(rows.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), id_col, m, [], 0.0)
    found = directions(triangle(rows, m), m.n, components)
    done = store(projected(rows, m, found))
    return _listed(done, id_col, m, found.explained, identity_error(done, found, m.n))


def _listed(done: DataFrame, id_col: str, m: Moments, explained: list[float], error: float) -> DataFrame:
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    out = done.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
