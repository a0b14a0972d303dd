"""Comparing the rows of each group with one another, in pieces of bounded size.

Rows are dealt and sorted by key. A task streams over its keys, keeps one group at a time and hands
it to a comparison. A group beyond the limit is not kept: it is passed on in numbered chunks, and a
second step compares every chunk with itself and every two chunks with each other, each pair of
chunks a cell of its own. So no task ever holds more than two chunks, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

Compare = Callable[[pa.RecordBatch, pa.RecordBatch | None], list[pa.Array] | None]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, limit: int | None) -> Iterator[tuple[pa.Table | None, pa.Table | None, int]]:
    """(group, None, 0) for groups of two rows or more, (None, chunk, number) for pieces of larger ones."""
    held: pa.Table | None = None
    chunk = 0

    def keys_of(t):
        return [t.column(i).to_numpy() for i in range(n_keys)]

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
            held = None
        if not t.num_rows:
            continue
        keys = keys_of(t)
        changed = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        ends = np.append(starts[1:], t.num_rows)
        sizes = ends - starts
        for at in np.flatnonzero(sizes[:-1] >= 2) if len(sizes) > 1 else ():
            if chunk and at == 0:
                continue
            if limit and sizes[at] > limit:
                for i, a in enumerate(range(starts[at], ends[at], limit)):
                    yield None, t.slice(a, min(limit, ends[at] - a)), i
            else:
                yield t.slice(starts[at], sizes[at]), None, 0
        if chunk and len(sizes) > 1:  # the end of a group that was too large
            for i, a in enumerate(range(0, ends[0], limit)):
                yield None, t.slice(a, min(limit, ends[0] - a)), chunk + i
            chunk = 0
        last = t.slice(starts[-1])
        while limit and last.num_rows > limit:
            yield None, last.slice(0, limit), chunk
            chunk += 1
            last = last.slice(limit)
        held = last
    if held is not None and chunk:
        yield None, held, chunk
    elif held is not None and held.num_rows >= 2:
        yield held, None, 0


def compared(rows: DataFrame, compare: Compare, out: pa.Schema, limit: int) -> DataFrame:
    """Rows of out for every group of rows with an equal, non-null first column `key` (long).

    compare(a, None) gets the rows of a group, compare(a, b) those of two pieces of one; it returns
    arrays for out, or None. limit bounds the rows of a piece. The result is checkpointed.
    """
    inner = to_arrow_schema(rows.schema)
    values = [f.name for f in inner][1:]
    outs = [pa.field(f.name, f.type) for f in out]
    both = pa.schema([pa.field("chunk", pa.int32()), *inner, *(pa.field(f"out_{f.name}", f.type) for f in outs)])

    def batch_of(t: pa.Table, first: int) -> pa.RecordBatch:
        t = t.select(t.column_names[first:]).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], names=t.column_names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[pa.Array]] = []
        waiting = 0

        def flush():
            cols = [pa.concat_arrays([k[i] for k in kept]) for i in range(len(outs))]
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *[pa.nulls(n, f.type) for f in inner], *cols], schema=both)

        for group, chunk, number in _groups(batches, 1, limit):
            if chunk is not None:
                for b in chunk.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.num_rows, number, np.int32)), *b.columns, *[pa.nulls(b.num_rows, f.type) for f in outs]], schema=both
                    )
            elif (got := compare(batch_of(group, 1), None)) is not None and len(got[0]):
                kept.append(got)
                waiting += len(got[0])
                if waiting >= 5000:
                    yield flush()
                    kept.clear()
                    waiting = 0
        if kept:
            yield flush()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, _ in _groups(batches, 3, None):
            ci, cj, own = group.column(1)[0].as_py(), group.column(2)[0].as_py(), group.column("chunk").to_numpy()
            pieces = [batch_of(group.filter(pa.array(own == c)), 4) for c in dict.fromkeys((ci, cj))]
            if len(pieces) == 2 and not (pieces[0].num_rows and pieces[1].num_rows):
                continue
            if (got := compare(pieces[0], pieces[1] if len(pieces) == 2 else None)) is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays(got, schema=pa.schema(outs))

    dealt = rows.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(stream, from_arrow_schema(both)).checkpoint()
    near = found.filter(F.col("chunk").isNull()).select(*[F.col(f"out_{n}").alias(n) for n in out.names])
    large = found.filter(F.col("chunk").isNotNull()).select("key", "chunk", *values)
    last = large.groupBy("key").agg(F.max("chunk").alias("last"))
    if last.isEmpty():
        return near
    paired = (
        large.join(last, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", *values)
    )
    far = paired.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").mapInArrow(cells, from_arrow_schema(out))
    return near.unionByName(far).checkpoint()


class Forest:
    """Components of n local rows; linking costs little where rows already hang together."""

    def __init__(self, n: int):
        self.comp = np.arange(n)
        self.members: dict[int, np.ndarray] = {}

    def link(self, rows: np.ndarray) -> None:
        got = self.comp[rows]
        if (got == got[0]).all():
            return
        roots = np.unique(got)
        lists = [self.members.pop(int(r), None) for r in roots]
        lists = [np.array([r]) if m is None else m for r, m in zip(roots, lists, strict=True)]
        to = int(roots[max(range(len(lists)), key=lambda i: len(lists[i]))])
        for m in lists:
            self.comp[m] = to
        self.members[to] = np.concatenate(lists)

    def heads(self, ids: np.ndarray) -> np.ndarray:
        """For each row the smallest id of its component."""
        order = np.lexsort((ids, self.comp))
        comp = self.comp[order]
        first = np.concatenate([[True], comp[1:] != comp[:-1]])
        out = np.empty(len(ids), ids.dtype)
        out[order] = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        return out
