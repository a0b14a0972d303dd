"""Toxicity by compression distance with two zstandard dictionaries.

Both dictionaries end in the same running ordinary text. Before it, one holds what zstandard trains on
what marks toxic texts, the other, of the same length, what it trains on windows of ordinary texts. A
text is measured window by window; a window is a word with the blanks around it. Its gain is the
number of bytes that the toxic dictionary saves against the ordinary one. What both have gains nothing.

Most words of a toxic text are ordinary, and labels mark texts, not words. So strings of a few bytes are counted by text:
those in a far larger share of toxic than of ordinary texts mark what the toxic dictionary is trained on, and ordinary words
with them are left out of the shared part, so that a string which ordinary texts also have now and then still gains. How much
of a text gains then tells the two apart, in any language and script: a logistic model turns the gains of
a text into a score. It is calibrated on texts that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, per_text

#: Labelled rows that the model is fitted on, at most: toxic and ordinary ones, of at most so many bytes each.
SAMPLE = (1500, 4000)
SAMPLE_TEXT_BYTES = 40_000
#: A score from here on is toxic. Toxic texts weigh more in the calibration, for this is above a half.
THRESHOLD, TOXIC_WEIGHT = 0.7, 2.0
#: Words of a piece of ordinary text for the dictionaries, and from one to the next; longer words count as several.
PIECE, STEP, WORD_BYTES = 12, 8, 64
#: Bytes of the part that both dictionaries share and of their trained parts.
SHARED_BYTES, TRAINED_BYTES = 300_000, 64 << 10
SEGMENT_BYTES = 24
#: Strings of so many bytes are counted by text; they mark toxic texts if they are in TIMES the share of ordinary texts, and surely so (standard errors).
STRINGS, TIMES, SURE, LEAST_TEXTS = (5, 6, 7), 3.0, 5.0, 4
#: Words of a run of marked words.
RUN = 8
#: Kinds of texts that are told apart by their bytes, at most, and texts of either label that a kind has at least.
KINDS, KIND_TEXTS = 8, 12
#: Pieces that a dictionary is trained on, at most.
SAMPLES = 40_000
#: Around a window, so that what is compressed is never stored as it is and matches are looked for up to its end.
BEFORE, AFTER = b"\0" * 48 + b" ", b" " + b"\0" * 24
#: Words whose gains a task remembers, at least, and words that are compressed at once.
REMEMBERED, AT_ONCE = 200_000, 20_000
#: Gains from which windows are counted for a score.
LEVELS = (1, 2, 3)


@dataclass(frozen=True)
class Model:
    shared: bytes
    ordinary: bytes
    toxic: bytes
    centres: np.ndarray
    weights: tuple[float, ...]


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows(raw: bytes, size: int = PIECE, step: int = STEP) -> np.ndarray:
    """(offset, length), as uint64, of the windows over the words of a text; words are runs without white space."""
    blank = np.frombuffer(raw, np.uint8) <= 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    if (ends - starts).max() > WORD_BYTES:
        n = -(-(ends - starts) // WORD_BYTES)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(starts, n) + within * WORD_BYTES
        ends = np.minimum(starts + WORD_BYTES, np.repeat(ends, n))
    first = np.arange(0, max(1, len(starts) - size + step), step)
    last = np.minimum(first + size, len(starts)) - 1
    return np.stack([starts[first], ends[last] - starts[first]], 1).astype(np.uint64)


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=20, hash_log=18, chain_log=19, search_log=5,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Distances:
    """Gains of the words of texts under two dictionaries; holds a few MB, and the gains of the words that it met last."""

    def __init__(self, shared: bytes, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary + shared), _compressor(toxic + shared)
        self.known: dict[bytes, int] = {}

    def of_words(self, words: list[bytes]) -> np.ndarray:
        pieces = [BEFORE + w + AFTER for w in words]
        sizes = np.array([len(p) for p in pieces], np.uint64)
        source = zstandard.BufferWithSegments(b"".join(pieces), np.stack([np.cumsum(sizes) - sizes, sizes], 1).tobytes())

        def lengths(compressor):
            out = compressor.multi_compress_to_buffer(source, threads=1)
            return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))

        return lengths(self.ordinary) - lengths(self.toxic)

    def gains(self, raw: bytes) -> np.ndarray:
        """The gain of each word of a text."""
        words = [raw[a : a + n] for a, n in windows(raw, 1, 1).tolist()]
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        own: dict[bytes, int] = {}
        for k in range(0, len(new), AT_ONCE):
            own.update(zip(new[k : k + AT_ONCE], self.of_words(new[k : k + AT_ONCE]).tolist()))
        got = np.fromiter((known[w] if w in known else own[w] for w in words), np.int64, len(words))
        if len(known) > REMEMBERED:
            known.clear()
        if len(own) <= REMEMBERED:
            known.update(own)
        return got


def features(gains: np.ndarray) -> list[float]:
    if not len(gains):
        gains = np.zeros(1, np.int64)
    total = float(np.maximum(gains, 0).sum())
    shares = [math.log1p(100 * float(np.mean(gains >= k))) for k in LEVELS]
    counts = [math.log1p(float((gains >= k).sum())) for k in LEVELS]
    return [1.0, float(gains.max()) / 5, math.log1p(total), math.log1p(100 * total / len(gains)), *shares, *counts]


def _trained(samples: list[bytes], rng: random.Random) -> bytes:
    """A dictionary of zstandard's trainer as content of a fixed length; the samples themselves where they are too few to train on."""
    samples = rng.sample(samples, min(len(samples), SAMPLES))
    try:
        got = zstandard.train_dictionary(TRAINED_BYTES, samples, k=SEGMENT_BYTES, d=6).as_bytes()
    except zstandard.ZstdError:
        got = b"\n".join(samples)
    return got[-TRAINED_BYTES:].rjust(TRAINED_BYTES, b"\0")


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; a toxic text counts TOXIC_WEIGHT times."""
    w, c = np.zeros(x.shape[1]), np.where(y > 0, TOXIC_WEIGHT, 1.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (c * (y - p)) - 0.05 * w)
    return tuple(map(float, w))


def _codes(raw: bytes, n: int) -> np.ndarray:
    """The distinct strings of n bytes (at most 8) within the words of a text, as numbers; a blank before a word counts as its first byte."""
    held = np.frombuffer(b" " + raw, np.uint8).copy()
    held[held <= 32] = 32
    if len(held) < n:
        return np.zeros(0, np.uint64)
    stretch = np.lib.stride_tricks.sliding_window_view(held, n)
    inside = (stretch[:, 1:] != 32).all(1)
    out = np.zeros(int(inside.sum()), np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | stretch[inside, k].astype(np.uint64)
    return np.unique(out)


def _marks(marked: list[bytes], plain: list[bytes]) -> frozenset[bytes]:
    """Strings that many more of the toxic texts hold than of the ordinary ones."""
    out: set[bytes] = set()
    m, o = len(marked), len(plain)
    for n in STRINGS if m and o else ():
        codes = [np.concatenate([np.zeros(0, np.uint64), *(_codes(t, n) for t in g)]) for g in (marked, plain)]
        names, at = np.unique(np.concatenate(codes), return_inverse=True)
        a, c = np.bincount(at[: len(codes[0])], minlength=len(names)), np.bincount(at[len(codes[0]) :], minlength=len(names))
        mean = (a + c) / (m + o)
        z = (a / m - c / o) / np.sqrt(mean * (1 - mean) * (1 / m + 1 / o) + 1e-12)
        chosen = names[(a >= LEAST_TEXTS) & (a / m >= TIMES * (c + 0.5) / o) & (z >= SURE)]
        out.update(int(x).to_bytes(n, "big") for x in chosen)
    return frozenset(out)


def profile(raw: bytes) -> np.ndarray:
    """How often a text has each byte, white space aside, on a unit sphere: texts of one script and alphabet are alike."""
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    held[:33] = 0
    held = np.sqrt(held)
    return held / max(np.linalg.norm(held), 1e-12)


def _kinds(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Centres of kinds of texts that are alike by profile (spherical k-means); kinds of too few texts are given up."""
    x = np.array([profile(t) for t in texts])
    centres = x[:1]
    for _ in range(KINDS - 1):  # the text that is least like any centre so far, among those of some length
        far = np.where(np.array([len(t) for t in texts]) >= 200, (x @ centres.T).max(1), 2.0)
        centres = np.vstack([centres, x[int(far.argmin())]])
    while True:
        for _ in range(15):
            own = (x @ centres.T).argmax(1)
            sums = np.stack([x[own == k].sum(0) for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        own = (x @ centres.T).argmax(1)
        few = [k for k in range(len(centres)) if toxic[own == k].sum() < KIND_TEXTS or (~toxic[own == k]).sum() < KIND_TEXTS]
        if not few or len(centres) == 1:
            return centres
        centres = np.delete(centres, min(few, key=lambda k: (own == k).sum()), axis=0)


def kind_of(raw: bytes, centres: np.ndarray) -> int:
    return int((centres @ profile(raw)).argmax())


class Marked(dict):
    """Whether a word holds a string of a set."""

    def __init__(self, strings: frozenset[bytes]):
        super().__init__()
        self.strings = strings

    def __missing__(self, word: bytes) -> bool:
        held = b" " + word
        got = self[word] = any(held[i : i + n] in self.strings for n in STRINGS for i in range(len(held) - n + 1))
        return got


def _stretches(texts: list[bytes], marked: Marked) -> list[bytes]:
    """The words of toxic texts that hold a marked string, in runs of a few."""
    out = []
    for raw in texts:
        words = [w[:WORD_BYTES] for w in raw.split() if marked[w]]
        out += [b" " + b" ".join(words[k : k + RUN]) + b" " for k in range(0, len(words), RUN)]
    return out


def _without(texts: list[bytes], marked: Marked) -> list[bytes]:
    return [b" ".join(w for w in raw.split() if not marked[w]) for raw in texts]


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Model | None:
    """A model from labelled texts; None unless there are texts of both kinds with words.

    Texts are parted in kinds by their bytes (script and alphabet); what marks toxic texts, and how much gain tells them apart, is found
    for each kind. Two thirds of the texts of a kind make the dictionaries, the last third calibrates the score.
    """
    rng = random.Random(seed)
    rows = [(lowered(t), bool(y)) for t, y in zip(texts, toxic, strict=True)]
    rng.shuffle(rows)
    cut = lambda raw: [raw[a : a + n] for a, n in windows(raw).tolist()]
    if len({y for raw, y in rows if raw.split()}) < 2:
        return None
    centres = _kinds([raw for raw, _ in rows], np.array([y for _, y in rows]))
    kinds: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in centres]
    for raw, y in rows:
        kinds[kind_of(raw, centres)][0 if y else 1].append(raw)
    pieces, hard = [], []
    seen = lambda group: [t for k, t in enumerate(group) if k % 3 < 2] if len(group) > 2 else group
    for bad, good in kinds:
        known = Marked(_marks(seen(bad), seen(good)))
        pieces += [p for raw in _without(seen(good), known) for p in cut(raw)]
        hard += _stretches(seen(bad), known)
    rng.shuffle(pieces)
    hard = hard or [p for bad, _ in kinds for raw in seen(bad) for p in cut(raw)]
    parts = b"\n".join(pieces)[:SHARED_BYTES], _trained(pieces, rng), _trained(hard, rng)
    distances, x, y = Distances(*parts), [], []
    for k, groups in enumerate(kinds):
        for label, group in zip((1.0, 0.0), groups):
            for raw in group[2::3] or group:  # what the dictionaries have not seen
                x.append(by_kind(features(distances.gains(raw)), k, len(centres)))
                y.append(label)
    return Model(*parts, centres, _fit(np.array(x), np.array(y)))


def by_kind(values: list[float], kind: int, kinds: int) -> list[float]:
    """Features of a text for the logistic model: common ones, and for its kind a level and a slope of its own."""
    own = [0.0] * (2 * kinds)
    own[2 * kind : 2 * kind + 2] = [1.0, values[3]]
    return values + own


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled rows that are not held out.

    The sample takes ids by hash order, so it is the same at every run; it is the only thing that
    comes to the driver: at most `sample` rows, without those of more than SAMPLE_TEXT_BYTES bytes. An
    id with several labels counts as toxic if one of them says so.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(id_col))
    )
    picked = [hash_sample(known.filter(F.col("toxic") == k), 3, [id_col], n) for k, n in ((1, sample[0]), (0, sample[1]))]
    ids = picked[0].unionByName(picked[1])
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    rows = texts.join(F.broadcast(ids), id_col).select(id_col, "text", "toxic").toPandas()
    rows = rows.sort_values([id_col, "text"])
    return train(rows["text"].tolist(), [int(y) for y in rows["toxic"]])


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, score (0 to 1) and predicted (1 from THRESHOLD on).

    Every whole text is scored, however long, one text at a time; null and empty texts score as a text
    without any gain. Without a model (labels of one kind only) all scores are 0. Repeated rows and
    null ids are kept; other columns are not looked at. One pass, without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 4 MB

    def worker():
        score = _scorer(sent.value)

        def apply(texts):
            got = np.array([score(t) for t in texts], float)
            return [pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))]

        return apply

    return per_text(docs, id_col, text_col, worker, pa.schema([("score", pa.float64()), ("predicted", pa.int32())]))


def _scorer(model: Model | None):
    if model is None:
        return lambda text: 0.0
    distances = Distances(model.shared, model.ordinary, model.toxic)

    def score(text: str) -> float:
        raw = lowered(text)
        values = by_kind(features(distances.gains(raw)), kind_of(raw, model.centres), len(model.centres))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(values, model.weights))))))

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score as toxic; all columns stay.

    Whole texts count, however long; null and empty texts stay, as do all rows without a model.
    """
    model = fitted(docs, labels, id_col, text_col)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = _scorer(sent.value)
        for texts in parts:
            yield texts.map(lambda t: bool(score(t or "") >= THRESHOLD)).astype(bool)

    return docs.filter(~toxic(F.col(text_col).cast("string")))
