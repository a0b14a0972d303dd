"""Embedding near-duplicates through a pivot-permutation index.

Reference vectors (pivots) are a sample of about 4 sqrt(n) distinct vectors, thinned so that no two
of them are close (a dense group would else get many pivots, whose order says little). Each vector is
described by its nearest pivots in order and posted in the inverted lists of those pivots. Two
vectors of a list are candidates if their descriptions share enough pivots (all of them, if there are fewer);
candidates are verified by their cosine in double precision. Every length of vectors has a pivot. A pair that meets in several lists counts in that of its
smallest shared pivot. Equal vectors are one class and are compared once. Lists beyond a bound are
compared in pieces, so nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .cells import Forest, compared
from .common import hash_sample, shared_checkpoints
from .components import components

#: Rows of a piece of an inverted list.
LIST_ROWS = 4096
#: Bounds of the sample of pivots, in vectors and in bytes; so many come to the driver and go to every executor.
PIVOTS, PIVOT_BYTES = (64, 1 << 16), 128 << 20
#: Pivots have a cosine below this with one another.
PIVOTS_APART = 0.5
OUT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _thinned(refs: np.ndarray) -> np.ndarray:
    """Greedily, in order: a reference stays if no earlier one that stays is close to it."""
    kept = np.empty_like(refs)
    n = 0
    for r in refs:
        if not n or (kept[:n] @ r).max() < PIVOTS_APART:
            kept[n] = r
            n += 1
    return kept[:n]


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = 0.95,
    nearest: int = 8,
    min_shared: int = 2,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    n_links counts other rows linked directly (cosine of at least min_cosine); component_id is the
    smallest id reachable; kept marks it. Vectors that are null, empty, zero or hold null or
    non-finite values link with nothing, as do vectors of other lengths with each other. Rows that
    repeat an id count as rows of their own. An empty table gives no rows; other columns are not
    looked at. Recall is that of the index (see the tests and the README), precision is 1. Vectors that
    all lie in one narrow cone have few pivots, so their lists are long: nothing is lost, but the time
    grows with the square of such a group.
    """
    spark = vectors.sparkSession
    shared_checkpoints(spark)
    values = F.col(vector_col).cast("array<double>")
    good = F.coalesce(
        F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good, values).alias("v")).select(
        "vec_id", "v", F.xxhash64(F.lit(seed), "v").alias("h1"), F.xxhash64(F.lit(seed + 1), "v").alias("h2")
    )
    valid = rows.filter(F.col("v").isNotNull())
    classes = (
        valid.groupBy("h1", "h2")
        .agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("c"), F.any_value("v").alias("v"))
        .filter(F.col("rep").isNotNull())
        .checkpoint()
    )
    total, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    wanted = min(max(PIVOTS[0], math.ceil(4 * math.sqrt(total))), PIVOTS[1], max(PIVOTS[0], PIVOT_BYTES // (8 * longest)))
    chosen = hash_sample(classes.select("v", "h1", "h2"), seed + 2, ["h1", "h2"], wanted)
    by_size: dict[int, list] = {}
    for r in chosen.select("v").toLocalIterator():
        by_size.setdefault(len(r.v), []).append(r.v)
    length = F.size("v")
    unmet = classes.filter(~length.isin(list(by_size))) if by_size else classes
    for r in unmet.groupBy(length.alias("d")).agg(F.min_by("v", F.struct("h1", "h2")).alias("v")).toLocalIterator():
        by_size[r.d] = [r.v]
    refs = {d: _thinned(_unit(np.array(p))) for d, p in by_size.items()}
    numbers = np.cumsum([0, *map(len, refs.values())])
    pivots = spark.sparkContext.broadcast({d: (int(at), p) for at, (d, p) in zip(numbers, refs.items())})

    narrow = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = np.float32 if narrow else np.float64

    def describe(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                if d not in pivots.value:
                    continue
                first, refs = pivots.value[int(d)]
                at = np.flatnonzero(sizes == d)
                x = flat[(ends[at] - d)[:, None] + np.arange(d)]
                k = min(nearest, len(refs))
                for a in range(0, len(at), 256):
                    part, some = x[a : a + 256], at[a : a + 256]
                    sims = _unit(part) @ refs.T
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
                    top = (np.take_along_axis(top, order, 1) + first).astype(np.int32)
                    raw = part.astype(kind)
                    pick = pa.array(np.repeat(np.arange(len(some)), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(top.ravel().astype(np.int64)),
                            pa.array(top.ravel()),
                            batch.column(0).take(pa.array(np.repeat(some, k))),
                            batch.column(1).take(pa.array(np.repeat(some, k))),
                            pa.array([t.tobytes() for t in top], pa.binary()).take(pick),
                            pa.array([r.tobytes() for r in raw], pa.binary()).take(pick),
                        ],
                        names=["key", "pivot", "rep", "c", "near", "v"],
                    )

    posted = classes.select("rep", "c", "v").mapInArrow(describe, "key long, pivot int, rep long, c long, near binary, v binary")

    def load(b: pa.RecordBatch):
        v = np.frombuffer(b"".join(b.column(4).to_pylist()), kind).reshape(b.num_rows, -1).astype(np.float64)
        near = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32).reshape(b.num_rows, -1)
        return int(b.column(0)[0].as_py()), b.column(1).to_numpy(), b.column(2).to_numpy(), near, _unit(v)

    def compare(a: pa.RecordBatch, b: pa.RecordBatch | None):
        pivot, reps, counts, near_a, unit_a = load(a)
        near_b, unit_b, shift = near_a, unit_a, 0
        if b is not None:
            _, more, more_counts, near_b, unit_b = load(b)
            reps, counts, shift = np.concatenate([reps, more]), np.concatenate([counts, more_counts]), len(unit_a)
        words, coded = np.unique(np.concatenate([near_a.ravel(), near_b.ravel()]), return_inverse=True)
        hot = lambda codes, shape: _incidence(codes.reshape(shape), len(words))
        has_a, has_b = hot(coded[: near_a.size], near_a.shape), hot(coded[near_a.size :], near_b.shape)
        below = int(np.searchsorted(words, pivot))
        links = np.zeros(len(reps), np.int64)
        forest = Forest(len(reps))
        for at in range(0, len(unit_a), 512):
            some = slice(at, at + 512)
            shared = has_a[some] @ has_b.T
            earlier = has_a[some, :below] @ has_b[:, :below].T
            ok = (shared >= min(min_shared, near_a.shape[1])) & (earlier == 0)
            i, j = np.nonzero(ok & (unit_a[some] @ unit_b.T >= min_cosine))
            i += at
            if b is None:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            j = j + shift
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            for x, others in zip(*_by_first(i, j), strict=True):
                forest.link(np.append(others, x))
        got = np.flatnonzero(links)
        if not len(got):
            return None
        heads = forest.heads(reps)
        return [pa.array(reps[got]), pa.array(links[got]), pa.array(heads[got])]

    linked = compared(posted, compare, OUT, LIST_ROWS)
    comps = components(linked.select(F.col("rep").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "rep")
    sums = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.select("h1", "h2", "rep", "c")
        .join(sums, "rep", "left")
        .join(comps, "rep", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "rep").alias("comp"))
    )
    out = valid.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select("vec_id", "n", "comp")
    bad = rows.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").cast("long").alias("comp"))
    return out.unionByName(bad).select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("comp", F.col("vec_id").cast("long")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("comp", "vec_id"), F.lit(True)).alias("kept"),
    )


def _incidence(codes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.float32)
    np.put_along_axis(out, codes, 1, axis=1)
    return out


def _by_first(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs gathered by their first row."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(i[1:] != i[:-1]) + 1
    return i[np.concatenate([[0], cuts])], np.split(j, cuts)
