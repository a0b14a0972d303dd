"""Benchmark decontamination by template windows.

Texts become templates: lower-case words, with typed placeholders for numbers, for units behind a
number, and, in a second form, for names (capitals inside a sentence), in a third also for capitals
that begin a sentence, the usual place of names in word problems. Every window of five template
words is hashed and joined with the windows of the benchmark. Where a matching window has slots, the
values of item and document must go together consistently, so that a question with other numbers or
names is found and a chance meeting of placeholders is not. They are checked for each occurrence of
an item (windows that lie in the document as they do in the item), since a document may hold several
variants, and over the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, shared_checkpoints, without

WINDOW = 5
MIN_COVERAGE = 0.8
MIN_SLOT_SHARE = 0.8
#: Share of the windows of an item that need fixed words where one occurrence alone is looked at.
MIN_ANCHORED = 0.5
#: Fixed words that an item of one window needs there.
MIN_FIXED = 3
#: Benchmark windows that may be sent to all executors; with more, both sides are shuffled by hash.
SENT_WINDOWS = 200_000

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n%]").findall
# Unit words, replaced behind a number.
UNITS = frozenset(
    "% mm cm m km inch inches ft feet yard yards mile miles mg g kg ton tons tonne tonnes lb lbs oz ounce ounces ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent "
    "cents pound pounds percent degree degrees hz khz mhz ghz w kw v mph kph".split()
)
END, NUM, UNIT, NAME, OFF = (np.uint64(x) for x in (2, 4, 6, 8, 0))
CAPITAL = 1
STEP = 0x9E3779B97F4A7C15
#: Words that a task remembers with their code, twice over at most.
REMEMBERED = 100_000
MATCHES = pa.schema(
    [("pos", pa.int64()), ("size", pa.int64()), ("last", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))]
)


def code_of(token: str) -> int:
    """Even code of the lower case of a token, with bit 0 for a capital."""
    if token in ".!?\n":
        return int(END)
    if token[0].isdigit():
        return int(NUM)
    return xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"), 7) >> 4 << 4 | 16 | CAPITAL * token[0].isupper()


def word_codes(vocabulary: dict[str, int] | None) -> Callable[[list[str]], np.ndarray]:
    """tokens -> their codes; words outside the vocabulary (of lower-case words), if there is one, have code 0 but for the bit of a capital."""
    if vocabulary is None:
        every = Remembered(code_of, REMEMBERED)
        return lambda tokens: np.fromiter(map(every.__getitem__, tokens), np.uint64, len(tokens))
    find = (vocabulary | dict.fromkeys(".!?\n", int(END))).get

    def of(tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0, np.uint64)
        lower = " ".join(tokens).lower().split(" ")
        codes = np.fromiter(map(find, lower, repeat(0)), np.uint64, len(tokens))
        firsts = np.frombuffer("".join(map(itemgetter(0), tokens)).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[(firsts >= ord("0")) & (firsts <= ord("9"))] = NUM
        codes[(firsts >= ord("A")) & (firsts <= ord("Z"))] |= np.uint64(CAPITAL)
        for i in np.flatnonzero(firsts > 127):
            if tokens[i][0].isdigit():
                codes[i] = NUM
            elif tokens[i][0].isupper():
                codes[i] |= np.uint64(CAPITAL)
        return codes

    return of


def template(text: str, codes: Callable[[list[str]], np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text, their codes with numbers and units replaced, those with names inside a sentence replaced too, and those with all capitals."""
    tokens = TOKEN(text)
    raw = codes(tokens)
    ends = raw == END
    begins = np.concatenate([[True], ends[:-1]]) if len(raw) else ends
    kept = np.flatnonzero(~ends)
    raw, begins = raw[kept], begins[kept]
    plain = raw & ~np.uint64(1)
    behind = np.flatnonzero(plain[:-1] == NUM) + 1
    if len(behind):
        # a unit outside the vocabulary has code 0, so its word is looked at
        for i in behind:
            if tokens[kept[i]].lower() in UNITS:
                plain[i] = UNIT
    capital = raw & np.uint64(1) == 1
    named = np.where(capital & ~begins, NAME, plain)
    every = np.where(capital, NAME, plain)
    return [tokens[i] for i in kept] if len(kept) < len(tokens) else tokens, plain, named, every


def windows(forms: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each form starts and hashes of its windows without a word that cannot match, but for those that are the same in the form before.

    What cannot match in the last form, which has the most placeholders, cannot in the others.
    """
    n = len(forms[-1]) - size + 1
    able = np.flatnonzero(forms[-1] != OFF)
    at = able[: len(able) - size + 1]
    at = at[able[size - 1 :] - at == size - 1] if n > 0 and len(able) >= size else able[:0]
    before = None
    for form in forms:
        words = [form[at + i] for i in range(size)]
        fit = np.logical_and.reduce([w != OFF for w in words])
        if before is not None:
            fit &= np.logical_or.reduce([w != v for w, v in zip(words, before)])
        before = words
        h = np.full(int(fit.sum()), size, np.uint64)
        for w in words:
            h = (h ^ w[fit]) * np.uint64(STEP)
            h ^= h >> np.uint64(29)
        yield at[fit], h


def _found(text: str, codes: Callable[[list[str]], np.ndarray], sizes: list[int], wanted: np.ndarray | None, item: bool = False):
    """(start, size, number of windows less one, hash, slot values) of the windows of all forms that are wanted."""
    words, *forms = template(text, codes)
    for size in sizes:
        for k, (form, (at, h)) in enumerate(zip(forms, windows(forms, size))):
            if wanted is not None and len(h):
                i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = wanted[i] == h
                at, h = at[hit], h[hit]
            for a, x in zip(at.tolist(), h.view(np.int64).tolist()):
                slots = [words[a + j].lower() for j in range(size) if form[a + j] <= NAME]
                # an item of one window has no other to go together with: a capital that begins it needs words beside it
                if k == 2 and item and len(words) == size and size - len(slots) < MIN_FIXED:
                    continue
                yield a, size, len(words) - size, x, slots


def template_windows(texts: DataFrame, id_col: str, text_col: str, sizes: list[int] | None, wanted=None, vocabulary=None) -> DataFrame:
    """id, pos, last, hash, slots for the windows of every whole text. sizes None: WINDOW words, or all of a shorter text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(vocabulary.value if vocabulary is not None else None)
        sought = wanted.value if wanted is not None else None
        for batch in batches:
            ids = batch.column(0)
            rows, cols = [], [[] for _ in MATCHES]
            texts = (t.as_py() for t in batch.column(1))  # one at a time
            for r, t in enumerate(texts):
                own = sizes
                if own is None:
                    n = len(template(t or "", codes)[1])
                    own = [min(n, WINDOW)] if n else []
                for got in _found(t or "", codes, own, sought, sizes is None):
                    rows.append(r)
                    for c, v in zip(cols, got):
                        c.append(v)
                if len(rows) > 20_000:
                    yield batch_of(ids, rows, cols)
                    rows, cols = [], [[] for _ in MATCHES]
            if rows:
                yield batch_of(ids, rows, cols)

    def batch_of(ids, rows, cols):
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), *[pa.array(c, f.type) for c, f in zip(cols, MATCHES)]], names=[id_col, *MATCHES.names]
        )

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, pos long, size long, last long, hash long, slots array<string>"
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, slot_share, verbatim: the pairs that are contaminated.

    coverage is the share of the windows of an item that come up in the document; slot_share the
    share of slots whose item value goes with its most frequent document value (1 without slots), in
    the best of the occurrences of the item and the document as a whole; verbatim says that all of
    these values are equal in one of them. An occurrence has the windows at one distance from their
    place in the item, or at distances within a quarter of its length (words put in or left out); one
    with the values of the item always counts. Null and empty texts and null ids take part in
    no pair; items of fewer than five words are one window. Rows that repeat an id count together.
    Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    doc = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    known = (
        template_windows(items, "item_id", "text", None)
        .select("item_id", F.col("pos").alias("item_pos"), F.col("size"), F.col("last").alias("item_last"), "hash", F.col("slots").alias("item_slots"))
        .checkpoint()
    )
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # five values at most
    if known.count() <= SENT_WINDOWS:
        hashes = np.unique(np.array([r[0] for r in known.select("hash").distinct().toLocalIterator()], np.int64).view(np.uint64))
        if not len(hashes):
            hashes = np.zeros(1, np.uint64)
        words = {t.lower(): c & ~1 for r in items.select("text").toLocalIterator() for t in TOKEN(r[0] or "") if (c := code_of(t)) > int(NAME) + 1}
        send = spark.sparkContext.broadcast
        found = template_windows(doc, "doc_id", "text", sizes, send(hashes), send(words))
        matched = found.join(F.broadcast(known), ["hash", "size"])
    else:
        matched = template_windows(doc, "doc_id", "text", sizes).join(known, ["hash", "size"])
    slack = F.greatest(F.lit(1), F.expr("(item_last + size) div 4"))
    shift = F.col("pos") - F.col("item_pos")
    places = [F.lit(0), shift, F.floor(shift / (2 * slack)), F.floor((shift + slack) / (2 * slack))]
    places = F.array(*[F.struct(F.lit(k).alias("level"), x.cast("long").alias("place")) for k, x in enumerate(places)])
    fixed = F.col("size") - F.size("slots")
    same = F.col("item_slots") == F.col("slots")
    placed = matched.select(
        "doc_id", "item_id", "item_pos", "item_last", F.arrays_zip("item_slots", "slots").alias("s"), same.alias("same"),
        (same | (fixed >= F.when(F.col("item_last") == 0, MIN_FIXED).otherwise(2))).alias("anchored"), F.inline(places),
    ).checkpoint()

    where = ["doc_id", "item_id", "level", "place"]
    covered = (
        placed.groupBy(*where, "item_pos")
        .agg(F.max("item_last").alias("last"), F.max("same").alias("equal"), F.max("anchored").alias("anchored"))
        .groupBy(*where)
        .agg(
            F.count("*").alias("n"), F.max(F.col("last") + 1).alias("of"),
            F.sum(F.col("equal").cast("long")).alias("n_equal"), F.sum(F.col("anchored").cast("long")).alias("n_anchored"),
        )
        .filter(F.col("n") >= min_coverage * F.col("of"))
    )
    pairs = (
        placed.select(*where, F.explode("s").alias("s"))
        .groupBy(*where, F.col("s.item_slots").alias("old"), F.col("s.slots").alias("new"))
        .agg(F.count("*").alias("c"))
        .groupBy(*where, "old")
        .agg(F.max("c").alias("top"), F.sum("c").alias("all"), F.min(F.col("old") == F.col("new")).alias("same"))
        .groupBy(*where)
        .agg((F.sum("top") / F.sum("all")).alias("slot_share"), F.min("same").alias("same"))
    )
    share = F.coalesce("slot_share", F.lit(1.0))
    equal = F.col("n_equal") >= min_coverage * F.col("of")
    # one occurrence of placeholders alone always goes together, so its windows need words
    anchored = (F.col("level") == 0) | (F.col("n_anchored") >= MIN_ANCHORED * F.col("of"))
    return (
        covered.join(pairs, where, "left")
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n").alias("n_windows"),
            F.max(F.col("n") / F.col("of")).alias("coverage"),
            F.max(share).alias("slot_share"),
            F.max(F.coalesce("same", F.lit(True))).alias("verbatim"),
            F.max(equal | (anchored & (share >= MIN_SLOT_SHARE))).alias("found"),
        )
        .filter("found")
        .drop("found")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay, null ids stay."""
    return without(docs, contaminated(docs, benchmark, id_col, text_col).select("doc_id"), id_col)
