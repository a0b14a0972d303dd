"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share all minima of one of the bands of a MinHash sketch; a pair at 0.8 shares none with a
probability of 0.0002. Every candidate is verified by its whole set of shingles, as 64-bit hashes.
Equal sets are one class. Buckets with the same members are compared once, and what leaves a bucket
is a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Forest, compared
from .common import SENT_IDS, Remembered, per_text, shared_checkpoints

WORDS_IN_SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
#: Rows of a piece of a bucket; each has the whole set of its text.
BUCKET_ROWS = 1024
#: Words that a task remembers with their hash, twice over at most.
REMEMBERED = 100_000
STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(29)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def word_hashes() -> Remembered:
    return Remembered(lambda w: xxhash.xxh64_intdigest(w, 5), REMEMBERED)


def shingles(text: str, hashes: Remembered, words_in_shingle: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(len(words), words_in_shingle)
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ each[i : i + n]) * STEP
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, (found[at : at + 4096, None] * FACTORS + TERMS).min(0))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: the id, own (hash of its set of shingles) and bands (a key for each band; none without words)."""

    def worker():
        hashes = word_hashes()

        def apply(texts):
            sets = [shingles(t, hashes) for t in texts]
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), 3) for s in sets], np.uint64).view(np.int64)
            low = np.stack([minima(s) for s in sets]).reshape(len(sets), BANDS, BAND_ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
            for i in range(BAND_ROWS):
                key = (key ^ low[:, :, i]) * STEP
                key = key ^ key >> np.uint64(29)
            keys = key.view(np.int64).tolist()
            return [pa.array(own), pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64()))]

        return apply

    return per_text(docs, id_col, text_col, worker, pa.schema([("own", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def whole_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: the id, own and shingles, the whole set as bytes."""

    def worker():
        hashes = word_hashes()

        def apply(texts):
            sets = [shingles(t, hashes).tobytes() for t in texts]
            return [pa.array(np.array([xxhash.xxh64_intdigest(s, 3) for s in sets], np.uint64).view(np.int64)), pa.array(sets, pa.binary())]

        return apply

    return per_text(docs, id_col, text_col, worker, pa.schema([("own", pa.int64()), ("shingles", pa.binary())]))


def similar_links(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b (long): links whose components are those of all pairs of at least min_similarity.

    Null and empty texts have the empty set and are alike. Rows with a null id take no part; rows
    that repeat an id count under it.
    """
    shared_checkpoints(docs.sparkSession)
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = sketches(named, "doc_id", "text").checkpoint()
    classes = prints.groupBy("own").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("bands").alias("bands")).checkpoint()
    equal = prints.select("doc_id", "own").join(classes.filter("n > 1").select("own", "rep"), "own").filter("doc_id <> rep")

    keyed = classes.select(F.explode("bands").alias("key"), "own", "rep")
    buckets = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("own").alias("least"), F.bit_xor(F.xxhash64("own")).alias("members"))
        .filter("n > 1")
        .groupBy("n", "least", "members")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    met = keyed.join(buckets, "key").checkpoint()
    ids = met.select(F.col("rep").alias("__rep")).distinct().checkpoint()
    side = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = named.join(side, F.col("doc_id") == F.col("__rep"), "left_semi")
    sets = whole_sets(texts, "doc_id", "text").dropDuplicates(["own", "doc_id"]).withColumnRenamed("doc_id", "rep")
    posted = met.join(sets, ["own", "rep"]).select("key", F.col("rep").cast("long").alias("rep"), "shingles")

    def compare(a: pa.RecordBatch, b: pa.RecordBatch | None):
        both = [a] if b is None else [a, b]
        reps = np.concatenate([x.column(0).to_numpy() for x in both])
        raw = [s for x in both for s in x.column(1).to_pylist()]
        sizes = np.array([len(s) // 8 for s in raw])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words, codes = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        forest, split = Forest(len(reps)), a.num_rows
        for i in range(split):
            to = np.arange(split if b is not None else i + 1, len(reps))
            to = to[forest.comp[to] != forest.comp[i]]
            # sets that differ more in size cannot be that similar
            to = to[np.minimum(sizes[to], sizes[i]) >= min_similarity * np.maximum(sizes[to], sizes[i])]
            if not len(to):
                continue
            has = np.zeros(len(words), bool)
            has[codes[starts[i] : starts[i] + sizes[i]]] = True
            if 4 * len(to) > len(reps):
                common = np.add.reduceat(has[codes], starts, dtype=np.int64)[to]
            else:
                common = np.array([np.count_nonzero(has[codes[starts[j] : starts[j] + sizes[j]]]) for j in to])
            near = to[common >= min_similarity * (sizes[to] + sizes[i] - common)]
            if len(near):
                forest.link(np.append(near, i))
        heads = forest.heads(reps)
        return [pa.array(reps[heads != reps]), pa.array(heads[heads != reps])]

    near = compared(posted, compare, pa.schema([("a", pa.int64()), ("b", pa.int64())]), BUCKET_ROWS)
    return near.unionByName(equal.select(F.col("doc_id").cast("long").alias("a"), F.col("rep").cast("long").alias("b")))
