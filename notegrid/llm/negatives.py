"""Hard negatives by exact inner product through an inverted multi-index.

Vectors are halved; each half has a codebook (k-means on a bounded sample), and the two codes of a row
name its cell. For an anchor the score of every row of a cell is at most a1.c1 + |a1| r1 + a2.c2 + |a2| r2,
with the radii of the two codes. Both lists of half-score bounds are sorted, and a heap visits pairs of
codes by falling sum (multi-sequence order) until the sum falls below a floor that certifies the window.

The floors come in two steps. Seed cells, the first of the order, give each anchor its best positives so
far; a second visit down to the last of them gives the exact positives. Their score windows then get
negatives from seed cells in the same way, and a last visit goes down to the lowest floor of any
window. All rows of a visited cell are scored in numpy, in integers, so the results are exact.

Cells are cut into pieces of bounded size. A task streams over its pieces: first the rows of a piece, then
the anchors that visit it. Neither rows nor anchors are copied, and none are gathered at the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, saved

#: Codes of a half; a half gets about the root of (rows / CELL_ROWS).
CODES, CELL_ROWS = 256, 1024
#: Rows of a piece of a cell, roughly (rows are dealt to pieces by a hash).
PIECE_ROWS = 2048
#: Lengths of vectors that have codebooks, the most frequent ones; all others share one cell.
BOOKS = 8
#: Bounds of the sample for k-means, in rows and bytes. It comes to the driver.
SAMPLE, SAMPLE_BYTES, ROUNDS = 20_000, 64 << 20, 8
#: Rows that the seed cells of an anchor hold at least.
SEED_ROWS = 4096
#: Scaled components are held within this, so that scores of up to 2,000 components fit in a long.
LARGEST = 1 << 26
#: Anchors that are compared with a piece at once.
AT_ONCE = 128

ROW = "rid long, vec_id long, label long, d int, x binary"
FOUND = "rid long, hi long, score long, vec_id long, other long"
NONE = -(1 << 62)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes * codes).sum(1) - 2 * (x @ codes.T), axis=1)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from k distinct random rows (fewer, if there are fewer)."""
    distinct = np.unique(x, axis=0)
    codes = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, codes)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(codes))
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


def _by_length(d: np.ndarray, packed: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for rows packed as int16 or int32."""
    for length in np.unique(d):
        at = np.flatnonzero(d == length)
        x = np.zeros((len(at), length), np.float64)
        short = np.array([len(packed[i]) == 2 * length for i in at], bool)
        for kind, some in ((np.int16, short), (np.int32, ~short)):
            if some.any() and length:
                x[some] = np.frombuffer(b"".join(packed[i] for i in at[some]), kind).reshape(-1, length)
        yield int(length), at, x


def _pack(x: np.ndarray) -> list[bytes]:
    small = np.abs(x).max(1, initial=0) < 1 << 15
    return [r.astype(np.int16 if s else np.int32).tobytes() for r, s in zip(x, small, strict=True)]


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows."""
    size = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if size < 1 << 53:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class Cells:
    """What all tasks know of the index: the codebooks, and for each cell its rows, pieces and radii."""

    def __init__(self, books: dict[int, tuple[int, np.ndarray, np.ndarray]], summary: list):
        self.books = books
        self.cells: dict[int, tuple[int, float, float]] = {r.cell: (r.n, r.r1, r.r2) for r in summary}
        self.wide = {}
        for length, (b, c1, c2) in books.items():
            r1, r2 = np.full(len(c1), -1.0), np.full(len(c2), -1.0)
            for cell, (_, x, y) in self.cells.items():
                if cell >> 16 == b:
                    i, j = cell >> 8 & 255, cell & 255
                    r1[i], r2[j] = max(r1[i], x), max(r2[j], y)
            self.wide[length] = (r1, r2)

    def visited(self, x: np.ndarray, length: int, floors: np.ndarray, least_rows: int) -> Iterator[tuple[int, list[int]]]:
        """(row of x, its cells): by falling bound until the floor, or until the cells hold least_rows if that is not 0."""
        a1, a2 = _halves(x)
        n1, n2 = _norms(a1), _norms(a2)
        near = lambda bound, size: bound + 1e-9 * size + 1e-3  # noqa: E731  what rounding may take
        rest = self.cells.get(0)
        if length in self.books:
            b, c1, c2 = self.books[length]
            r1, r2 = self.wide[length]
            s1, s2 = a1 @ c1.T, a2 @ c2.T
            u1 = np.where(r1 >= 0, s1 + n1[:, None] * r1, -np.inf)
            u2 = np.where(r2 >= 0, s2 + n2[:, None] * r2, -np.inf)
            o1, o2 = np.argsort(-u1, axis=1, kind="stable"), np.argsort(-u2, axis=1, kind="stable")
        for k in range(len(x)):
            floor, cells, rows = floors[k], [], 0
            if length not in self.books:
                if rest and near(n1[k] * rest[1] + n2[k] * rest[2], 0) * (1 + 1e-9) >= floor:
                    cells.append(0)
                yield k, cells
                continue
            p, q = u1[k][o1[k]], u2[k][o2[k]]
            size = np.abs(p[np.isfinite(p)]).max(initial=0) + np.abs(q[np.isfinite(q)]).max(initial=0)
            heap, seen = [(-(p[0] + q[0]), 0, 0)], {(0, 0)}
            while heap:
                bound, i, j = heapq.heappop(heap)
                if not np.isfinite(bound) or near(-bound, size) < floor or (least_rows and rows >= least_rows):
                    break
                i1, i2 = int(o1[k][i]), int(o2[k][j])
                own = self.cells.get(b << 16 | i1 << 8 | i2)
                if own and near(s1[k, i1] + n1[k] * own[1] + s2[k, i2] + n2[k] * own[2], size) >= floor:
                    cells.append(b << 16 | i1 << 8 | i2)
                    rows += own[0]
                for m, n in ((i + 1, j), (i, j + 1)):
                    if m < len(p) and n < len(q) and (m, n) not in seen:
                        seen.add((m, n))
                        heapq.heappush(heap, (-(p[m] + q[n]), m, n))
            yield k, cells


def _top(scores: np.ndarray, ok: np.ndarray, vec_id: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed columns of each row: score, then smaller vec_id, then rid."""
    if ok.shape[1] > k:
        masked = np.where(ok, scores, NONE)
        ok &= scores >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(ok)
    order = np.lexsort((rid[j], vec_id[j], -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep]


def _scored(visits: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND: for each visit of an anchor to a piece the k best rows of its label, or of other labels in each window.

    visits: piece, rid, label, d, x and the windows lo, hi (arrays; one without an upper end for positives).
    """
    kind = "piece long, kind int, rid long, vec_id long, label long, d int, x binary, lo array<long>, hi array<long>"
    none = F.lit(None).cast("array<long>")
    met = rows.join(visits.select("piece").distinct(), "piece", "left_semi")
    both = met.select("piece", F.lit(0).alias("kind"), *_names(ROW), none.alias("lo"), none.alias("hi")).unionByName(
        visits.select("piece", F.lit(1).alias("kind"), "rid", F.lit(None).cast("long").alias("vec_id"), "label", "d", "x", "lo", "hi")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, parts, loaded = None, [], None
        for batch in batches:
            pieces, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((pieces[1:] != pieces[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if pieces[a] != piece:
                    piece, parts, loaded = pieces[a], [], None
                if kinds[a] == 0:
                    parts.append(part)
                    continue
                if loaded is None:
                    t = pa.Table.from_batches(parts, schema=batch.schema).combine_chunks()
                    rid, label = t["rid"].to_numpy(), t["label"].to_numpy()
                    vec_id = t["vec_id"].fill_null((1 << 63) - 1).to_numpy()
                    loaded = {n: (x, rid[at], vec_id[at], label[at]) for n, at, x in _by_length(t["d"].to_numpy(), t["x"].to_pylist())}
                    parts = []
                for at in range(0, part.num_rows, AT_ONCE):
                    yield from _compared(part.slice(at, AT_ONCE), loaded, k, same)

    dealt = both.repartition("piece").sortWithinPartitions("piece", "kind").select(*_names(kind))
    return dealt.mapInArrow(run, FOUND)


def _compared(anchors: pa.RecordBatch, loaded: dict, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    own, labels = anchors.column("rid").to_numpy(), anchors.column("label").to_numpy()
    lows, highs = anchors.column("lo"), anchors.column("hi")
    for length, at, a in _by_length(anchors.column("d").to_numpy(), anchors.column("x").to_pylist()):
        if length not in loaded:
            continue
        x, rid, vec_id, label = loaded[length]
        scores = _products(a, x)
        alike = labels[at][:, None] == label[None, :]
        out = []
        for w in range(1 if same else max(len(lows[int(i)]) for i in at)):  # the windows of an anchor, one after the other
            held = np.array([len(lows[int(i)]) > w for i in at], bool)
            lo = np.array([lows[int(i)][w].as_py() if h else 0 for i, h in zip(at, held)], np.int64)
            hi = np.array([highs[int(i)][w].as_py() if h else -1 for i, h in zip(at, held)], np.int64)
            ok = (scores >= lo[:, None]) & held[:, None]
            ok &= (alike & (rid[None, :] != own[at][:, None])) if same else (~alike & (scores <= hi[:, None]))
            i, j = _top(scores, ok, vec_id, rid, k)
            if len(i):
                out.append((own[at][i], hi[i], scores[i, j], vec_id[j], rid[j]))
        if out:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            ids = pa.array(cols[3], mask=cols[3] == (1 << 63) - 1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), ids, pa.array(cols[4])], names=_names(FOUND))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    seed: int = 31,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component). The positives of an anchor are its best
    other rows of the same label; for each, the best rows of other labels with a score of between
    percent[0] and percent[1] hundredths of the positive's are returned, all if they are fewer than asked for. Higher
    scores come first, then smaller ids, then (rows that repeat an id) either order.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Rows with a
    null id are no anchors and come last among ties; rows that repeat an id are rows of their own. Vectors of
    different lengths do not meet; empty ones score zero with one another. Scaled components beyond 2^26
    count as 2^26 or -2^26. Ids and labels are cast to long. An empty table gives no rows; other columns of
    vectors are not looked at. Every result is exact.
    """
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    bounded = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    taking_part = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(label_col).isNotNull()
    rows = vectors.filter(F.coalesce(taking_part, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(values, bounded).alias("v"),
    )
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(BOOKS).collect()
    books = {}
    for b, r in enumerate(sizes, 1):
        k = int(min(CODES, max(1, (r.n / CELL_ROWS) ** 0.5)))
        if k > 1 and r.d > 1:
            most = max(4 * CODES, min(SAMPLE, SAMPLE_BYTES // (8 * r.d)))
            got = hash_sample(rows.filter(F.size("v") == r.d).select("v"), seed, ["v"], most).toPandas()
            halves = _halves(np.array(got["v"].tolist(), np.float64))
            books[r.d] = (b, *(codebook(h, k, seed + i) for i, h in enumerate(halves)))
        else:  # one code, zero
            books[r.d] = (b, np.zeros((1, r.d // 2)), np.zeros((1, r.d - r.d // 2)))
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            flat, sizes = lists.values.to_numpy(), np.diff(ends)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[ends[at][:, None] + np.arange(d)].astype(np.float64)
                b, c1, c2 = sent.value.get(int(d), (0, np.zeros((1, d // 2)), np.zeros((1, d - d // 2))))
                x1, x2 = _halves(x)
                i1, i2 = _nearest(x1, c1), _nearest(x2, c2)
                cell = (b << 16) + (i1 << 8) + i2
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(at)) for k in range(4)),
                        pa.array(np.full(len(at), d, np.int32)),
                        pa.array(_pack(x), pa.binary()),
                        pa.array(cell.astype(np.int64)),
                        pa.array(_norms(x1 - c1[i1]) * (1 + 1e-12)),
                        pa.array(_norms(x2 - c2[i2]) * (1 + 1e-12)),
                    ],
                    names=["rid", "vec_id", "label", "anchor", "d", "x", "cell", "r1", "r2"],
                )

    indexed = saved(rows.mapInArrow(assign, "rid long, vec_id long, label long, anchor boolean, d int, x binary, cell long, r1 double, r2 double"), "multi-index")
    summary = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    found = summary.collect()  # at most BOOKS * CODES^2 + 1 cells
    cells = spark.sparkContext.broadcast(Cells(books, found))
    in_pieces = spark.createDataFrame([(r.cell, -(-r.n // PIECE_ROWS)) for r in found], "cell long, pieces long")
    located = indexed.join(F.broadcast(in_pieces), "cell").select(
        (F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("rid"), F.col("pieces"))).alias("piece"), *_names(ROW)
    )
    anchors = indexed.filter("anchor").select("rid", "vec_id", "label", "d", "x")

    def visits(asked: DataFrame, least_rows: int) -> DataFrame:
        """asked: rid, label, d, x, lo, hi (the floor of a visit is the least lo); a row for each piece that is visited."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lows = [min(v) for v in batch.column(4).to_pylist()]
                for d, at, x in _by_length(batch.column(2).to_numpy(), batch.column(3).to_pylist()):
                    for k, own in cells.value.visited(x, d, np.array([lows[i] for i in at], np.float64), least_rows):
                        pieces = [(c << 32) + p for c in own for p in range(-(-cells.value.cells[c][0] // PIECE_ROWS))]
                        if pieces:
                            rest = batch.take(pa.array(np.full(len(pieces), at[k])))
                            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), *rest.columns], names=["piece", *batch.schema.names])

        asked = asked.select("rid", "label", "d", "x", "lo", "hi")
        return asked.mapInArrow(run, "piece long, rid long, label long, d int, x binary, lo array<long>, hi array<long>")

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("rid", "hi").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def floor_of(found: DataFrame, k: int) -> DataFrame:
        """The k-th score of each window that has so many."""
        return found.filter(F.col("rank") == k).select("rid", "hi", F.col("score").alias("floor"))

    whole = anchors.withColumns({"lo": F.array(F.lit(NONE).cast("long")), "hi": F.array(F.lit(0).cast("long"))})
    seeds = floor_of(best(_scored(visits(whole, SEED_ROWS), located, positives, True), positives), positives)
    certified = whole.join(seeds.select("rid", "floor"), "rid", "left").withColumn("lo", F.array(F.coalesce("floor", F.lit(NONE))))
    mates = saved(best(_scored(visits(certified, 0), located, positives, True), positives).select("rid", "vec_id", "score", "rank"), "positives")

    # ceil(percent * score / 100) in whole numbers; a window whose lower end is above its upper end holds nothing
    low = F.expr(f"-((-{percent[0]} * score) div 100) + if((-{percent[0]} * score) % 100 < 0, 1, 0)").alias("lo")
    high = F.expr(f"({percent[1]} * score) div 100 - if(({percent[1]} * score) % 100 < 0, 1, 0)").alias("hi")
    windows = mates.select("rid", "score", low, high).distinct()
    windows = windows.filter("lo <= hi").groupBy("rid", "hi").agg(F.min("lo").alias("lo"))
    packed = lambda w: anchors.join(w.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("w")), "rid").select("rid", "label", "d", "x", "w.lo", "w.hi")
    seeds = floor_of(best(_scored(visits(packed(windows), SEED_ROWS), located, negatives, False), negatives), negatives)
    raised = windows.join(seeds, ["rid", "hi"], "left").select("rid", "hi", F.greatest("lo", "floor").alias("lo"))
    against = best(_scored(visits(packed(raised), 0), located, negatives, False), negatives)
    return (
        mates.select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low, high)
        .join(against.select("rid", "hi", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["rid", "hi"])
        .filter("negative_score >= lo")
        .join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
