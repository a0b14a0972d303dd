"""Secrets in texts, also inside nested encodings.

A worklist holds layers: the text itself, then every percent, backslash, base64 (on one line or
wrapped over several) and compressed run that decodes, whatever it decodes to: bytes are read as Latin-1, which keeps all of ASCII in its place,
and without their NULs too, which is how the ASCII of UTF-16 and UTF-32 comes out. Each layer is scanned by the same patterns and searched for further runs, until
no new layer comes up; a layer seen before (same content, same place) ends its branch. What is
found in a decoded layer is reported at the run of the original text that holds it.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"
#: A decompressed layer is read in pieces of about this many bytes, cut at white space where there is any
#: in MAX_RUN_BYTES; each piece starts with the last OVERLAP_BYTES or more of the one before.
PIECE_BYTES, MAX_RUN_BYTES, OVERLAP_BYTES = 8 << 20, 64 << 20, 1 << 16

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

RUN = re.compile(r"[^\x20\x09-\x0D]+")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{4,}+)++={0,2}+(?![A-Za-z0-9+/_=-])")
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,8})\}|U([0-9A-Fa-f]{8})|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
#: A percent sign that is encoded over and over; it is unwrapped at once, and counts as one layer.
NESTED = re.compile(r"%(?:25){4,}([0-9A-Fa-f]{2})")


def scan(text: str):
    """(kind, start, end) of the base patterns in one layer."""
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 8:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def readings(raw: bytes) -> Iterator[str]:
    """Bytes as text, and without NULs if there are any."""
    if raw:
        yield raw.decode("latin-1")
        if b"\0" in raw:
            yield raw.replace(b"\0", b"").decode("latin-1")


def unescaped(m: re.Match) -> str:
    code = int(m[m.lastindex], 16)
    return chr(code) if code <= 0x10FFFF else m[0]


def compressed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0)


def inflated(blocks: Iterator[bytes], wbits: int = 47) -> Iterator[bytes]:
    """Content of gzip or zlib data (with wbits -15: bare deflate), block by block, over all members; up to the first error."""
    member, between = zlib.decompressobj(wbits=wbits), False
    for block in blocks:
        while block:
            if between:  # members may be padded with zeros
                block = block.lstrip(b"\0")
                if not block:
                    break
                member, between = zlib.decompressobj(wbits=wbits), False
            try:
                out = member.decompress(block, 1 << 20)
            except zlib.error:
                return
            if out:
                yield out
            between = member.eof
            block = member.unused_data if member.eof else member.unconsumed_tail
    while not between:
        try:
            out = member.decompress(member.unconsumed_tail, 1 << 20)
        except zlib.error:
            return
        if not out:
            return
        yield out


def pieces(blocks: Iterator[bytes]) -> Iterator[str]:
    """Text of a layer in overlapping pieces; no run and no character is cut if there is white space."""
    held, kept, seen = bytearray(), 0, set()

    def piece(raw: bytes):
        mark = xxhash.xxh3_128_intdigest(raw)
        if mark not in seen:
            seen.add(mark)
            yield from readings(raw)

    for block in blocks:
        held += block
        while len(held) - kept >= PIECE_BYTES:
            end = max(held.rfind(c, kept) for c in b" \t\n\v\f\r") + 1
            if end <= kept:
                if len(held) - kept < MAX_RUN_BYTES:
                    break
                end = len(held)
            yield from piece(bytes(held[:end]))
            start = max(0, end - OVERLAP_BYTES)
            space = max(held.rfind(c, 0, start) for c in b" \t\n\v\f\r") + 1
            start = space if space and start - space <= OVERLAP_BYTES else start
            while start < end and held[start] & 0xC0 == 0x80:
                start += 1
            del held[:start]
            kept = end - start
    if len(held) > kept or not seen:
        yield from piece(bytes(held))


def unwrapped(run: str) -> Iterator[str]:
    """Texts of a base64 run, through any number of compressed layers; several if a layer is large."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    if not compressed(raw):
        yield from readings(raw)
        yield from pieces(inflated(iter((raw,)), -15))
        return
    blocks, head, seen = iter((raw,)), raw, set()
    while compressed(head) and head not in seen:
        seen.add(head)
        blocks = inflated(blocks)
        head = b""
        for block in blocks:
            head += block
            if len(head) > 2:
                break
        blocks = itertools.chain((head,), blocks)
    if head:
        yield from pieces(blocks)


def decoded_runs(text: str):
    """(start, end, text) of every run of a layer that decodes to something else."""
    if "%" in text:
        for m in RUN.finditer(text):
            if PERCENT.search(m[0]):
                for inner in readings(unquote_to_bytes(NESTED.sub(r"%\1", m[0]).encode("latin-1", "replace"))):
                    yield m.start(), m.end(), inner
    if "\\" in text:
        for m in RUN.finditer(text):
            if (inner := ESCAPE.sub(unescaped, m[0])) != m[0]:
                yield m.start(), m.end(), inner
                if "\0" in inner:
                    yield m.start(), m.end(), inner.replace("\0", "")
    for m in BASE64.finditer(text):
        for inner in unwrapped(m[0]):
            yield m.start(), m.end(), inner
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = m[0].split()
            # what looks like a last line may be a word of other text
            for n, end in ((len(lines), m.end()), (len(lines) - 1, m.start() + m[0].rfind(lines[-2]) + len(lines[-2]))):
                for inner in unwrapped("".join(lines[:n])) if n > 1 else ():
                    yield m.start(), end, inner


def spans_of(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, depth, base) by start, then kind as listed; depth counts layers."""
    found = {(kind, a, b): (0, True) for kind, a, b in scan(text)}
    work: list[tuple[int, int, Iterator[str]]] = []  # a branch: one iterator of layers for each depth
    seen: set[tuple[int, int, int]] = set()
    for a, b, first in decoded_runs(text):
        work.append((a, b, iter((first,))))
        while work:
            layer = next(work[-1][2], None)
            if layer is None:
                work.pop()
                continue
            mark = (a, b, xxhash.xxh3_128_intdigest(layer.encode("utf-8", "surrogatepass")))
            if mark in seen:
                continue
            seen.add(mark)
            for kind, _, _ in scan(layer):
                depth = min(len(work), found.get((kind, a, b), (len(work), False))[0])
                found[kind, a, b] = (depth, (kind, a, b) in found and found[kind, a, b][1])
            work.append((a, b, (inner for _, _, inner in decoded_runs(layer))))
    return [(*k, *found[k]) for k in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("base", pa.bool_())])
)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id and spans, array<struct<kind, start, end, depth, base>>.

    base marks what the patterns match in the text itself; other spans are encoded runs that hold
    a secret. Offsets are code points, end exclusive. Null and empty texts have no spans; whole texts
    are scanned, however long; repeated rows and null ids are kept; other columns are not looked at. One pass, without a shuffle.
    """

    def worker():
        names = ("kind", "start", "end", "depth", "base")

        def apply(texts):
            return [pa.array([[dict(zip(names, s)) for s in spans_of(t)] for t in texts], SPANS)]

        return apply

    return per_text(docs, id_col, text_col, worker, pa.schema([("spans", SPANS)]))


def masked(text: str) -> str:
    """text with every span replaced by MASK; spans that touch or overlap become one."""
    out, at, end = [], 0, -1
    for _, a, b, _, _ in spans_of(text):
        if a > end:
            out += [text[at:a], MASK]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets of every text replaced, however long; all rows and columns stay, null texts stay null.

    Empty texts, null ids and repeated rows stay as they are.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text_col, mask(F.col(text_col)))
