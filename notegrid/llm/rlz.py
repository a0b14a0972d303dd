"""Substring deduplication by relative Lempel-Ziv factors.

The corpus is the reference. Every 20-word window picks one of its 6-word phrases (that of the least
hash), so equal windows pick equal phrases; the windows of a text that pick the same phrase at the
same place form a block of 20 to 34 words. Blocks are the index: a block that stands earlier in the
corpus is copied from its first place there. A block whose phrase is known but whose ends differ lies
at the boundary of a factor; there the windows are compared one by one. Parsing goes from left to
right and is greedy: a factor (source, place, length) goes on as long as the next block or window
continues at the source, and where it ends the next one starts. So the words in factors of 20 words or
more are exactly those of all windows that start earlier elsewhere. Blocks and windows are equal if two
64-bit hashes are.

Of equal blocks (or windows) in one Arrow batch only the first is looked up in the corpus, the others
are known to come later, so a passage that many texts share costs each batch one lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OUT_ROWS, Remembered, saved

WINDOW, PHRASE = 20, 6
STEP = 0x9E3779B97F4A7C15
#: Words that a task remembers with their hash, twice over at most.
REMEMBERED = 200_000
FIRST, LATER, BOUNDARY = 0, 1, 2
NULL_ID = -(1 << 63)


def word_hashes() -> Remembered:
    return Remembered(lambda word: xxhash.xxh64_intdigest(word, 9), REMEMBERED)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(STEP, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, put together from runs of powers of two."""
    parts, run, at, out = {1: words}, 1, 0, None
    while run * 2 <= size:
        h = parts[run]
        parts[run * 2] = h[:-run] * _power(run) + h[run:]
        run *= 2
    n = len(words) - size + 1
    for run in sorted(parts, reverse=True):
        if size & run:
            piece = parts[run][at : at + n]
            out = piece if out is None else out * _power(run) + piece
            at += run
    return _mixed(out)


def least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the least of width values, the leftmost of equals."""
    place, run = np.arange(len(h)), 1
    while run < width:
        step = min(run, width - run)
        a, b = place[:-step], place[step:]
        place = np.where(h[b] < h[a], b, a)
        run += step
    return place


def windows_of(texts: list[list[bytes]], hashes: Remembered):
    """Words of many texts in a row: (text of each window, start in that text, window hash, phrase place, phrase hash)."""
    flat = [w for t in texts for w in t]
    words = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(flat) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    at = np.flatnonzero(owner[WINDOW - 1 :] == owner[: len(flat) - WINDOW + 1])
    phrases = rolled(words, PHRASE)
    picked = least_at(phrases, WINDOW - PHRASE + 1)[at]
    firsts = np.cumsum(sizes) - sizes
    return owner[at], at - firsts[owner[at]], rolled(words, WINDOW)[at], picked, phrases[picked]


def _parts(batch: pa.RecordBatch):
    """(first row, ids, texts as words, other columns) of pieces of an Arrow batch; only one piece is held as words."""
    for a in range(0, batch.num_rows, OUT_ROWS):
        part = batch.slice(a, OUT_ROWS)
        yield part.column(0).to_numpy(), [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(1).to_pylist()], part.columns[2:]


def _first_in_batch(same: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of the batch that is equal to it (by same) and comes first, and whether its place is an earlier one."""
    by = np.lexsort([*reversed(place), *reversed(same)])
    equal = np.logical_and.reduce([k[by][1:] == k[by][:-1] for k in same])
    group = np.concatenate([[0], np.cumsum(~equal)])
    head = np.concatenate([[0], np.flatnonzero(~equal) + 1])[group]
    first, later = np.empty(len(by), np.int64), np.zeros(len(by), bool)
    first[by] = by[head]
    later[by] = np.logical_or.reduce([p[by] != p[by][head] for p in place])
    return first, later


BLOCKS = "key long, block long, d long, start int, n int, kind int, src long, at int, t long"


def _dealt(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS from (key, block, d, start, n, t); rows known to come later in the corpus have their source and are dealt by their id."""
    if not parts:
        return
    key, block, d, start, n, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(key):
        return
    first, later = _first_in_batch([key, block], [d, start])
    dealt = np.where(later, _mixed(d.view(np.uint64)), key).view(np.int64)
    cols = [dealt, block.view(np.int64), d, start.astype(np.int32), n.astype(np.int32), np.where(later, LATER, FIRST).astype(np.int32), d[first], start[first].astype(np.int32), t]
    names = ["key", "block", "d", "start", "n", "kind", "src", "at", "t"]
    for a in range(0, len(key), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in cols], names=names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of each text."""
    hashes = word_hashes()
    for batch in batches:
        parts = []
        for ids, texts, (marks,) in _parts(batch):
            owner, start, window, picked, phrase = windows_of(texts, hashes)
            if not len(owner):
                continue
            lo = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
            hi = np.append(lo[1:], len(owner)) - 1
            block = _mixed(window[lo] * _power(2) + window[hi] * _power(1) + (hi - lo).astype(np.uint64))
            parts.append((phrase[lo], block, ids[owner[lo]], start[lo], hi - lo + 1, marks.to_numpy()[owner[lo]]))
        yield from _dealt(parts)
    pa.default_memory_pool().release_unused()


SPANS = "d long, start int, n int, kind int, src long, at int, t long"


def _spans(d, start, n, kind, src, at, t) -> pa.RecordBatch:
    cols = [d, start, n, np.asarray(kind, np.int32), src, at, t]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "start", "n", "kind", "src", "at", "t"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, block, id and start: later copies of blocks, and first ones at a boundary.

    Only the block at hand and the first block of its phrase are kept between batches.
    """
    key = block = first = waiting = None  # of the last row; first: place of the block's first row
    several = False
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        known = cols[5] == LATER
        if known.any():
            yield _spans(*(c[known] for c in cols[2:]))
            cols = [c[~known] for c in cols]
        keys, blocks, d, start, n, t = *cols[:5], cols[8]
        if not len(keys):
            continue
        new_key = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        new_block = new_key | np.concatenate([[block is None or blocks[0] != block], blocks[1:] != blocks[:-1]])
        heads = np.flatnonzero(new_block)
        of = np.cumsum(new_block) - 1
        head_d, head_start = d[heads], start[heads]
        if not new_block[0]:
            head_d, head_start, of = np.append(first[0], head_d), np.append(first[1], head_start), of + 1
        later = ~new_block & ((d != head_d[of]) | (start != head_start[of]))
        # runs of a phrase: those of several blocks have their first rows at a boundary
        run = np.cumsum(new_key)  # 0: goes on from the last batch
        per_run = np.bincount(run, weights=new_block, minlength=run[-1] + 1).astype(int)
        many = per_run >= 2
        if not new_key[0]:
            many[0] = several or per_run[0] >= 1
            if many[0] and waiting is not None:
                yield waiting
                waiting = None
        # rows of other texts under the same id, at the same place, are first ones too; they are always taken apart
        boundary = (new_block & many[run]) | (~new_block & ~later)
        kind = np.where(later, LATER, BOUNDARY)[later | boundary]
        if len(kind):
            pick = later | boundary
            yield _spans(d[pick], start[pick], n[pick], kind, head_d[of][pick], head_start[of][pick], t[pick])
        if new_key.any():
            waiting = None
        several = bool(many[run[-1]])
        last_run_heads = heads[run[heads] == run[-1]]
        if not several and len(last_run_heads):
            i = last_run_heads[0]
            waiting = _spans(d[i : i + 1], start[i : i + 1], n[i : i + 1], [BOUNDARY], d[i : i + 1], start[i : i + 1], t[i : i + 1])
        key, block, first = keys[-1], blocks[-1], (head_d[of[-1]], head_start[of[-1]])


def _boundary_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks at boundaries, in the shape of blocks of one window."""
    hashes = word_hashes()
    for batch in batches:
        parts = []
        for ids, texts, (spans, marks) in _parts(batch):
            owner, start, window, _, phrase = windows_of(texts, hashes)
            if not len(owner):
                continue
            at = np.flatnonzero(_covered(spans, np.bincount(owner, minlength=len(spans))))
            parts.append((window[at], phrase[at], ids[owner[at]], start[at], np.ones(len(at), np.int32), marks.to_numpy()[owner[at]]))
        yield from _dealt(parts)
    pa.default_memory_pool().release_unused()


def _covered(spans: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Marks, over rows of the given sizes laid end to end, the places that the spans (start, n) of each row cover."""
    rows = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    firsts = np.cumsum(sizes) - sizes
    delta = np.zeros(int(sizes.sum()) + 1, np.int64)
    lo = np.minimum(start, sizes[rows]) + firsts[rows]
    hi = np.minimum(start + n, sizes[rows]) + firsts[rows]
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi, -1)
    return np.cumsum(delta)[:-1] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, (spans,) in _parts(batch):
            sizes = np.array([len(t) for t in texts])
            gone = _covered(spans, sizes)
            ends = np.cumsum(sizes)
            removed, out = [], []
            for t, lo, hi in zip(texts, (ends - sizes).tolist(), ends.tolist()):
                mask = gone[lo:hi]
                n = int(mask.sum())
                removed.append(n)
                out.append((b" ".join([w for w, g in zip(t, mask.tolist()) if not g]) if n else b" ".join(t)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(sizes.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                names=["d", "n_words", "n_removed", "kept"],
            )


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, text and t, a hash of the text: rows that repeat an id have spans of their own, and equal rows have equal ones."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), text.alias("text"), F.xxhash64(text).alias("t"))


def _copies(texts: DataFrame) -> DataFrame:
    """d, t, start, n, src, at: n windows of the text t of d in a row from start on that stand earlier, in src from at on."""
    dealt = texts.select("d", "text", "t").mapInArrow(_blocks, BLOCKS).repartition("key")
    found = saved(dealt.sortWithinPartitions("key", "block", "d", "start").mapInArrow(_looked_up, SPANS), "blocks")
    asked = found.filter(F.col("kind") == BOUNDARY).groupBy("d", "t").agg(_as_list())
    ends = (
        texts.join(asked, ["d", "t"])
        .select("d", "text", "spans", "t")
        .mapInArrow(_boundary_windows, BLOCKS)
        .repartition("key")
        .sortWithinPartitions("key", "block", "d", "start")
        .mapInArrow(_looked_up, SPANS)
    )
    return found.filter(F.col("kind") == LATER).unionByName(ends.filter(F.col("kind") == LATER)).drop("kind")


def _as_list():
    return F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))).alias("spans")


def _factors(copies: DataFrame) -> DataFrame:
    """d, t, start, n_words, src, source_start: copies that go on at the same distance from their source, joined."""
    shifted = copies.distinct().withColumn("shift", F.col("at") - F.col("start"))
    order = Window.partitionBy("d", "t", "src", "shift").orderBy("start")
    new = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("n")).over(order), F.lit(True))
    joined = (
        shifted.withColumn("new", new.cast("int"))
        .withColumn("factor", F.sum("new").over(order))
        .groupBy("d", "t", "src", "shift", "factor")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    )
    return joined.select(
        "d", "t", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start") + WINDOW - 1).cast("long").alias("n"),
        "src", (F.col("start") + F.col("shift")).cast("long").alias("source_start"),
    )


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words, source_id, source_start: the factors of 20 words or more, in words from 0 on.

    The n_words words from start on stand in the same order in the source (a document of a smaller id,
    or an earlier place of the same one) from source_start on. Factors may overlap by up to 19 words. Null
    and empty texts have none; texts of any length are parsed whole; each row that repeats an id has factors
    of its own, equal rows once; null ids come before all others. An empty table gives no rows. Ids are cast to long.
    """
    kind = docs.schema[id_col].dataType
    id_of = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).cast(kind)
    return _factors(_copies(_named(docs, id_col, text_col))).select(
        id_of("d").alias("doc_id"), "start", F.col("n").alias("n_words"), id_of("src").alias("source_id"), "source_start"
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space) for every row of docs.

    A word goes if a factor covers it, which is to say: if a window of 20 words that covers it also starts earlier, in a document of a
    smaller id, or before it in the same one; windows are those of the input. Null and empty texts
    have no words; texts of any length are looked at whole. Rows that repeat an id are texts of their own, of which none is earlier
    than the other at the same place; a null id comes before all others. Ids are cast to long. An empty table gives no rows; other columns are not looked at.
    """
    texts = _named(docs, id_col, text_col)
    spans = _factors(_copies(texts)).groupBy("d", "t").agg(_as_list())
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    out = (
        texts.join(spans, ["d", "t"], "left")
        .select("d", "text", F.coalesce("spans", none).alias("spans"))
        .mapInArrow(_kept, "d long, n_words long, n_removed long, kept string")
    )
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("d") != NULL_ID, F.col("d")).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept")
