"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) are always reported once their check passes, with their score. The
added kinds are reported from a score of MIN_SCORE on: iban (length of its country and mod 97), unless
words near it speak against it, and ssn, which has no checksum and so needs a context word near it.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
MIN_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT = 48

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Country and length of account numbers.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: What follows the first four characters, for each length.
IBAN_REST = {n: re.compile(rf"(?:[\x20-]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
NOT_DIGIT = re.compile(r"[^0-9]+")

START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
#: Words near a span that make its kind likelier, and words that speak against any kind.
FOR_IT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "login", " ip"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "serial")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Walks from @ to @, so that long runs of letters cost no more than once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            floor = m.end()
            yield start, floor
        at = text.find("@", m.end() if m else at + 1)


def proposals(text: str):
    """(kind, start, end) of all spans whose check passes."""
    for a, b in emails(text):
        yield "email", a, b
    for m in IP.finditer(text):
        if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN_START.finditer(text):
        rest = IBAN_REST[n].match(text, m.end()) if (n := IBAN_LENGTHS.get(m[1])) else None
        if rest and mod97(re.sub(r"[\x20-]", "", m[0] + rest[0])):
            yield "iban", m.start(), rest.end()
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind as listed, with scores from 0 to 1."""
    found = []
    for kind, a, b in proposals(text):
        near = (text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]).lower()
        score = START_SCORE[kind] + 0.3 * any(w in near for w in FOR_IT[kind]) - 0.2 * any(w in near for w in AGAINST)
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= MIN_SCORE:
            found.append((kind, a, b, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id and spans, array<struct<kind, start, end, score>>.

    Offsets are code points of the whole text, however long, end exclusive. Null and empty texts have no
    spans; repeated rows and null ids are kept as they come; other columns are not looked at. One pass
    over the texts, without a shuffle.
    """

    def worker():
        def apply(texts):
            return [pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] for t in texts], SPANS)]

        return apply

    return per_text(docs, id_col, text_col, worker, pa.schema([("spans", SPANS)]))


def span_digests(found: DataFrame, base: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a table of spans: counts of base kinds, base_sha256 and spans as text, with their scores where they have any.

    Spans come sorted; a base span may be marked as not base by a null-free boolean field `base`,
    where the element type has one.
    """
    fields = {f.name for f in found.schema["spans"].dataType.elementType.fields}
    is_base = (lambda s: s["base"]) if "base" in fields else (lambda s: s["kind"].isin(*base))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", is_base)
    of_kind = lambda k: F.filter(own, lambda s: s["kind"] == F.lit(k))
    return found.select(
        id_col,
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *([F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")] if "score" in fields else []),
    )
