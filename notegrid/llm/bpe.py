"""BPE encoding and decoding by speculation: greedy longest match, pair checks, exact merging.

A token sequence of a word is its BPE encoding if each token encodes to itself and no merge ever
crosses the boundary of two neighbours. Greedy longest match proposes a sequence; all boundaries of
all new words of a batch are then checked at once in numpy; words that fail are merged exactly.
Texts are cut at ASCII white space, which the vocabulary's splitter never crosses, and each task
remembers the encoding of the chunks it has met. Cutting, numbering the chunks of a batch and putting
their ids together again is Arrow's work; Python sees each different chunk of a batch once.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Chunks and words that a worker remembers with their encoding, twice over at most.
REMEMBERED, REMEMBERED_WORDS = 220_000, 110_000
#: Longer chunks and words are not remembered, so the memories are bounded in bytes (about 150 MB).
REMEMBERED_LENGTH = 48
#: In place of a part that went into the one before it.
GONE = -1
#: What the file's normalizer and splitter come to on lower-case printable ASCII, and the digest of the rules for which that holds.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\x20]+").findall
ASCII_RULES = "d5be8fc62f03c6f970615877744b6fb5"
#: Symbols up to which a word is merged by the least of a list, and characters that the library splits at once.
SHORT, SPLIT_AT_ONCE = 64, 20_000
#: Bytes of texts, but for those of one, that a task takes apart at once.
TEXT_BYTES = 8 << 20


class Vocabulary:
    """A tokenizers file with a BPE model that marks the end of a word by a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or model["dropout"] or model["unk_token"] or model["fuse_unk"] or model["ignore_merges"]:
            raise ValueError("not a plain BPE file")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens of this kind are not known here")
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search
        self.texts = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = pa.array([self.texts.get(i) for i in range(max(self.texts) + 1)], pa.string())
        self.longest = max(map(len, self.ids))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.width = max(self.texts) + 1
        self.codes = {pair: r * self.width + t for pair, (r, t) in self.ranks.items()}
        rules = json.dumps([spec["normalizer"], spec["pre_tokenizer"]], sort_keys=True)
        self.ascii_split = ASCII_SPLIT if hashlib.md5(rules.encode()).hexdigest() == ASCII_RULES else None
        self.known_words: dict[str, bytes] = {}
        self.known_chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self._tables()
        self.own = {t: i for t, i in self.ids.items() if self._whole(i)}

    def _tables(self) -> None:
        """For the pair check: how each token is made, when, and which pairs merge when."""
        n = max(self.texts) + 1
        self.made = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.odd: set[int] = set()
        for (a, b), (r, t) in sorted(self.ranks.items(), key=lambda x: x[1]):
            if self.made[t] >= 0 or self.made[a] >= r or self.made[b] >= r:
                self.odd.add(t)  # made in two ways, or before its parts: never proposed
            else:
                self.made[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * n + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.when = np.array([r for r, _ in self.ranks.values()], np.int64)[order]

    def _whole(self, token: int) -> bool:
        """Does the text of a token encode to that token? Then it may be proposed."""
        if token in self.odd:
            return False
        text = self.texts[token]
        end = self.suffix if self.suffix and text.endswith(self.suffix) else ""
        return self.made[token] < 0 or self.merged(self.symbols(text.removesuffix(end), end)) == [token]

    def symbols(self, word: str, suffix: str) -> list[int]:
        """Ids of the characters of a word, the last with the suffix."""
        return [self.ids[c] for c in (*word[:-1], word[-1:] + suffix) if c in self.ids]

    def merged(self, parts: list[int]) -> list[int]:
        """Exact merging: the earliest learnt pair first, the leftmost of equals.

        A short word looks for the least rank in a list. In longer ones pairs wait in a heap by (rank,
        place); parts are a linked list, so a word of n characters costs O(n log n). An entry whose left part has changed since is passed over.
        """
        if len(parts) <= SHORT:
            return self._merged_short(list(parts))
        ids, find = list(parts), self.ranks.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := find((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, whole = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            k = after[j]
            ids[i], ids[j], after[i] = whole, GONE, k
            if k < n:
                before[k] = i
                if r := find((whole, ids[k])):
                    heappush(heap, (r[0], i, whole, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := find((ids[h], whole))):
                heappush(heap, (r[0], h, ids[h], whole, r[1]))
        return [t for t in ids if t != GONE]

    def _merged_short(self, ids: list[int]) -> list[int]:
        never = 1 << 62
        find, width = self.codes.get, self.width
        codes = [find(pair, never) for pair in zip(ids, ids[1:])]
        while codes and (least := min(codes)) != never:
            i, whole = codes.index(least), least % width
            ids[i : i + 2] = (whole,)
            del codes[i]
            if i:
                codes[i - 1] = find((ids[i - 1], whole), never)
            if i < len(codes):
                codes[i] = find((whole, ids[i + 1]), never)
        return ids

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match over a word, whose last token carries the suffix; None where nothing matches."""
        out, at, n, own, longest, suffix = [], 0, len(word), self.own, self.longest, self.suffix
        while at < n:
            if n - at <= longest and (t := own.get(word[at:] + suffix)) is not None:
                out.append(t)
                return out
            for to in range(min(n - 1, at + longest), at, -1):
                if (t := own.get(word[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:
                return None
        return out

    def crossed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does a merge cross their boundary while they are built?

        Goes back in time: x and y are the parts at the boundary, until is the merge that ends the
        time in which both stand there. At a tie the leftmost merge wins, so one that swallows y at
        the same rank comes later than the crossing, and one that swallows x comes earlier.
        """
        x, y = first.copy(), second.copy()
        until = np.full(len(x), 1 << 60, np.int64)
        bad = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            key = a * self.width + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.when[at] < until[live])
            bad[live[hit]] = True
            made_a, made_b = self.made[a], self.made[b]
            split_a = made_a > made_b
            until[live] = np.where(split_a, made_a, made_b + 1)
            x[live] = np.where(split_a, self.right[a], a)
            y[live] = np.where(split_a, b, self.left[b])
            live = live[~hit & ((made_a >= 0) | (made_b >= 0))]
        return bad

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words as the splitter gives them, in its byte characters."""
        if not words:
            return []
        guesses = [self.proposed(w) for w in words]
        counts = np.array([len(g or ()) for g in guesses])
        flat = np.array([t for g in guesses for t in g or ()], np.int64)
        owner = np.repeat(np.arange(len(words)), counts)
        inside = owner[1:] == owner[:-1]
        failed = np.array([g is None for g in guesses], bool)
        failed[owner[1:][inside][self.crossed(flat[:-1][inside], flat[1:][inside])]] = True
        for i in np.flatnonzero(failed):
            guesses[i] = self.merged(self.symbols(words[i], self.suffix))
        return guesses

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids, as int32 bytes, of chunks without ASCII white space."""
        pieces, words, other = [], {}, []
        for chunk in chunks:
            rest, row = chunk, []
            if self.ascii_split and chunk.isascii() and chunk.isprintable() and not self.has_special(chunk):
                pieces.append([words.setdefault(w, len(words)) for w in self.ascii_split(chunk.lower())])
                continue
            if self.ascii_split and len(chunk) <= REMEMBERED_LENGTH and chunk.split() == [chunk] and not self.has_special(chunk):
                other.append(len(pieces))
                pieces.append(row)
                continue
            while rest:
                at, name = min(((rest.find(s), s) for s in self.special if s in rest), key=lambda x: (x[0], -len(x[1])), default=(len(rest), ""))
                if at:
                    for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(rest[:at])):
                        row.append(words.setdefault(w, len(words)))
                if name:
                    row.append(-1 - self.special[name])
                rest = rest[at + len(name) :]
            pieces.append(row)
        for row, found in zip(other, self.split_apart([chunks[i] for i in other]), strict=True):
            pieces[row] = [words.setdefault(w, len(words)) for w in found]
        if len(self.known_words) > REMEMBERED_WORDS:
            self.older_words, self.known_words = self.known_words, {}
        found, older = self.known_words, self.older_words
        new = []
        for w in words:
            if w not in found:
                if (got := older.get(w)) is not None:
                    found[w] = got
                else:
                    new.append(w)
        for w, ids in zip(new, self.encode_words(new), strict=True):
            found[w] = array("i", ids).tobytes()
        known = [found[w] for w in words]
        for w in new:
            if len(w) > REMEMBERED_LENGTH:
                del found[w]
        return [b"".join([known[p] if p >= 0 else array("i", (-1 - p,)).tobytes() for p in row]) for row in pieces]

    def split_apart(self, chunks: list[str]) -> list[list[str]]:
        """The words of chunks without any white space and special tokens, as the library splits them.

        Nothing in the normalizer or the splitter reaches over a blank, so chunks are joined by blanks
        and the library is called once for many. Should blanks have gone or come, each has its own call.
        """
        words = self.splitter.pre_tokenize_str
        out: list[list[str]] = []
        at = 0
        while at < len(chunks):
            to, size = at, 0
            while to < len(chunks) and size < SPLIT_AT_ONCE:
                size += len(chunks[to])
                to += 1
            text = self.normalizer.normalize_str(" ".join(chunks[at:to]))
            normal = text.split(" ")
            if len(normal) == to - at:
                found: list[list[str]] = [[] for _ in normal]
                ends = np.cumsum([len(c) + 1 for c in normal])
                split = words(text)
                for row, (word, _) in zip(np.searchsorted(ends, [start for _, (start, _) in split], "right").tolist(), split):
                    found[row].append(word)
                out += found
            else:
                out += [[w for w, _ in words(self.normalizer.normalize_str(c))] for c in chunks[at:to]]
            at = to
        return out

    def chunks_of(self, rows: list[list[str]]) -> dict[str, bytes]:
        """The encodings of at least all chunks of rows."""
        if len(self.known_chunks) > REMEMBERED:
            self.older_chunks, self.known_chunks = self.known_chunks, {}
        known, older = self.known_chunks, self.older_chunks
        lacking = {c for row in rows for c in row if c not in known}
        again = [c for c in lacking if c in older]
        known.update(zip(again, [older[c] for c in again], strict=True))
        new = list(lacking.difference(again))
        known.update(zip(new, self.encode_chunks(new), strict=True))
        self.passing = [c for c in new if len(c) > REMEMBERED_LENGTH]
        return known

    def forget(self) -> None:
        """Drops the long chunks of the last call of chunks_of."""
        for c in self.passing:
            del self.known_chunks[c]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of whole texts."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.values.dictionary_encode()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        encoded = list(map(self.chunks_of([chunks]).__getitem__, chunks))
        self.forget()
        ends = np.cumsum([0, *map(len, encoded)], dtype=np.int64) // 4
        each = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
        met = each.take(numbered.indices)
        starts = met.offsets.to_numpy()[split.offsets.to_numpy()]
        return pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), met.values[starts[0] : starts[-1]])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Without a decoder in the file, tokens are joined by spaces."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row of docs: the id, ids array<int>, and decoded string (null if not asked for).

    The ids are those of the tokenizers library without special tokens added; special tokens that
    stand in a text are recognised. Null and empty texts give an empty array and ''. Whole texts are
    encoded, however long, also those of one word (n log n). Repeated rows
    and null ids are kept; other columns are not looked at. One pass, without a shuffle. The path
    must be readable where tasks run; None takes the file of the public_tokenizers package there.
    """

    def worker():
        path = vocabulary_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        vocab = vocabulary(path)

        def apply(texts):
            cuts = np.flatnonzero(np.diff(np.cumsum([*map(len, texts)]) // TEXT_BYTES)) + 1
            parts = [vocab.encode(texts[lo:hi]) for lo, hi in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
            lists = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
            return [lists, vocab.decode(lists) if decoded else pa.nulls(len(texts), pa.string())]

        return apply

    schema = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return per_text(docs, id_col, text_col, worker, schema)


def encoding_digests(encoded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens, columns to keep, and the SHA-256 of the ids (decimal, joined by a space) and of the decoded text."""
    return encoded.select(
        id_col,
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
