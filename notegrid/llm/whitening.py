"""Whitening of embeddings: exact covariance, QDWH divide and conquer, broadcast projection.

Components become whole numbers, so sums and products are exact: the sums come first, then products of rows
centred at the rounded mean, which leaves small numbers, and the part of the mean that rounding left is taken off in
whole numbers before the one division. Each task adds up its rows and sends one row of products for
each dimension; these are summed by dimension. Only a matrix of the size of a vector, whatever the number of rows,
reaches the driver, where `spectral` splits it, and goes out again with the projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import saved
from .spectral import spectral

#: Scaled components are held within this.
LARGEST = 1 << 24
#: Sums of a task that wait, over all lengths of vectors.
WAITING = 1 << 20
#: Rows that are multiplied at once.
AT_ONCE = 4096
#: Components whose share of the largest eigenvalue is below this many roundings have none of their own.
ROUNDINGS = 64


def whole(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64) + offset


def _lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a list column without nulls."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for a in range(0, len(at), AT_ONCE):
            some = at[a : a + AT_ONCE]
            yield int(d), some, flat[offsets[some][:, None] + np.arange(d)]


def _products(y: np.ndarray) -> Iterator[np.ndarray]:
    """Exact y.T @ y in pieces that fit in a long."""
    most = int(np.abs(y).max(initial=1)) ** 2
    if most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        yield (f.T @ f).astype(np.int64)
    else:
        step = max(1, (1 << 62) // most)
        for a in range(0, len(y), step):
            yield y[a : a + step].T @ y[a : a + step]


def _added(partial: DataFrame, kind: type, width: int) -> DataFrame:
    """partial: i, task, and binary rows a, b of width numbers; both summed over the tasks, in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                own = sums.setdefault(i, [np.zeros(width, kind), np.zeros(width, kind)])
                own[0] += np.frombuffer(a, kind)
                own[1] += np.frombuffer(b, kind)
        for i, (a, b) in sums.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    return partial.repartition("i").sortWithinPartitions("i", "task").mapInArrow(run, "i int, a binary, b binary")


def _partial(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(len(a), dtype=np.int32)),
            pa.array(np.full(len(a), task, np.int32)),
            pa.array([r.tobytes() for r in a], pa.binary()),
            pa.array([r.tobytes() for r in b], pa.binary()),
        ],
        names=["i", "task", "a", "b"],
    )


PARTIAL = "i int, task int, a binary, b binary"


def covariance(rows: DataFrame, n: int, sums: list[int], scale: int, offset: int) -> np.ndarray:
    """Of the whole-number vectors whose n and sums are given, over the only array column of rows; rounded once."""
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((d, d), np.int64), np.zeros((d, d), np.int64)
        for batch in batches:
            for length, _, x in _lists(batch.column(0)):
                if length == d:
                    for g in _products(whole(x, scale, offset) - centre):
                        high += g >> 32
                        low += g & 0xFFFFFFFF
        yield _partial(high, low)

    got = {r.i: r for r in _added(rows.mapInArrow(run, PARTIAL), np.int64, d).collect()}  # d rows
    left = [s - n * c for s, c in zip(sums, middle, strict=True)]
    out = np.zeros((d, d))
    for i in range(d):
        high, low = np.frombuffer(got[i].a, np.int64).tolist(), np.frombuffer(got[i].b, np.int64).tolist()
        for j in range(d):
            out[i, j] = (n * ((high[j] << 32) + low[j]) - left[i] * left[j]) / (n * n)
    return out


def whitened(
    vectors: DataFrame,
    components: int = 32,
    scale: int = 64,
    offset: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and component.

    A component c of a vector counts as x = floor(scale * c) + offset. Components are the unit eigenvectors of the covariance of
    all rows, numbered from 1 by falling eigenvalue; whitened is (x - mean) projected on one, over the root of
    its eigenvalue; explained its share of the trace; deviation the exact sum of (n * x - sum of x)^2 over the
    dimensions; identity_error the largest absolute entry of the covariance of whitened minus the identity.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those whose length is not the most
    frequent one (of equally frequent ones the longer). floor(scale * c) is held within 2^24. Rows with null or repeated ids are rows of
    their own; a deviation beyond a long is null. Directions in which the vectors do not vary, up to rounding, are
    no components: a table of equal vectors, an empty table or one of empty vectors gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.filter(good).select(F.col(id_col).alias("vec_id"), values.alias("v"))
    kind = StructType(
        [StructField("vec_id", rows.schema["vec_id"].dataType)]
        + [StructField(name, t()) for name, t in (("component", IntegerType), ("n", LongType), ("deviation", LongType), ("whitened", DoubleType), ("explained", DoubleType))]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flushed():
            keys = sorted(sums)
            dims = [np.arange(-1, d, dtype=np.int32) for d in keys]
            out = [np.repeat(np.array(keys, np.int32), [k + 1 for k in keys]), np.concatenate(dims), np.concatenate([sums[k] for k in keys])]
            sums.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["d", "i", "total"])

        for batch in batches:
            for d, at, x in _lists(batch.column(0)):
                own = sums.setdefault(d, np.zeros(d + 1, np.int64))
                own[0] += len(at)
                own[1:] += whole(x, scale, offset).sum(0)
            if sum(map(len, sums.values())) > WAITING:
                yield flushed()
        if sums:
            yield flushed()

    counted = rows.select("v").mapInArrow(add_up, "d int, i int, total long").groupBy("d", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = saved(counted, "whitening sums")
    usual = totals.filter("i = -1").orderBy(F.desc("total"), F.desc("d")).first()
    out = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if usual is None or not usual.d:
        return spark.createDataFrame([], kind).withColumn("identity_error", F.lit(0.0)).select(out)
    n, d = int(usual.total), usual.d
    sums = [int(r.total) for r in totals.filter((F.col("d") == d) & (F.col("i") >= 0)).orderBy("i").collect()]
    v = covariance(rows.select("v"), n, sums, scale, offset)
    e, u = spectral(v)
    k = int((e[:components] > ROUNDINGS * d * np.finfo(float).eps * max(e[0], 0)).sum())
    if not k:
        return spark.createDataFrame([], kind).withColumn("identity_error", F.lit(0.0)).select(out)
    sent = spark.sparkContext.broadcast((u[:, :k] / np.sqrt(e[:k]), sums, e[:k] / np.trace(v)))

    def apart(x: np.ndarray) -> np.ndarray:
        """n * x - S, in whole numbers."""
        s = sent.value[1]
        middle = [a // n for a in s]
        small = whole(x, scale, offset) - np.array(middle)  # |small| <= 2^26
        left = [a - n * c for a, c in zip(s, middle, strict=True)]
        if n < 1 << 36:
            return n * small - np.array(left)
        return n * small.astype(object) - np.array(left, object)

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = apart(x)
        return off, (off / n).astype(np.float64) @ sent.value[0]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for length, _, x in _lists(batch.column(0)):
                if length == d:
                    z = projected(x)[1]
                    squares += z.T @ z
                    plain += z.sum(0)
        yield _partial(squares, np.repeat(plain[:, None], k, axis=1))

    got = sorted(_added(rows.select("v").mapInArrow(measured, PARTIAL), np.float64, k).collect())  # k rows
    squares = np.array([np.frombuffer(r.a) for r in got]) / n
    means = np.array([np.frombuffer(r.b)[0] for r in got]) / n
    error = float(np.abs(squares - np.outer(means, means) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = sent.value[2]
        for batch in batches:
            for length, at, x in _lists(batch.column(1)):
                for a in range(0, len(at) if length == d else 0, 256):
                    some = at[a : a + 256]
                    off, z = projected(x[a : a + 256])
                    if int(np.abs(off).max()) ** 2 * d >= 1 << 62:
                        off = off.astype(object)
                    deviation = pa.array([s if s < 1 << 63 else None for s in (off * off).sum(1).tolist()], pa.int64())
                    each = pa.array(np.repeat(np.arange(len(some)), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(some)).take(each),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                            pa.array(np.full(len(some) * k, n)),
                            deviation.take(each),
                            pa.array(z.ravel()),
                            pa.array(np.tile(shares, len(some))),
                        ],
                        names=kind.names,
                    )

    return rows.mapInArrow(project, kind).withColumn("identity_error", F.lit(error)).select(out)
