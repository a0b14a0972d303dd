"""Text normalisation, dates, tokens: column expressions, and one Arrow helper for full Unicode folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..params import STOPWORDS

#: White space, as Python's str.strip() takes it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def folded(text: str) -> str:
    """Casefold, decompose, drop combining marks."""
    text = text.casefold()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _tables() -> tuple[str, str, dict[str, str]]:
    """What `translate` needs to fold: characters that fold to one other, their folds, then those that vanish; and the few letters that fold to several."""
    single, marks, several = {}, [], {}
    for code in range(0x41, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:  # surrogates; syllables whose parts count the same together
            continue
        to = folded(c)
        if not to and unicodedata.combining(c):
            marks.append(c)
        elif len(to) == 1 and to != c:
            single[c] = to
        elif len(to) > 1 and unicodedata.category(c)[0] == "L" and (code < 0x250 or 0x1E00 <= code < 0x1F00 or 0xFB00 <= code < 0xFB07):
            several[c] = to
    return "".join(single) + "".join(marks), "".join(single.values()), several


FOLDED, FOLDS, SEVERAL = _tables()


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Casefold, decompose, drop combining marks: exact for all scripts."""

    return texts.map(lambda t: None if t is None else folded(t))


def fold_letters(c: Column) -> Column:
    """The same in the JVM, for the letters and marks of the basic plane (Hangul syllables and the like stay whole)."""
    expanded = c
    for letter, to in SEVERAL.items():
        expanded = F.replace(expanded, F.lit(letter), F.lit(to))
    letters = F.when(c.rlike("[" + "".join(SEVERAL) + "]"), expanded).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(letters, FOLDED, FOLDS))


def stripped(c: Column | str) -> Column:
    """Without the white space of Unicode at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def right_stripped(c: Column | str) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once a row however often use names it, also inside lambdas."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def norm_path(c: Column) -> Column:
    """Slashes turned, trimmed, lower case; accents stay."""
    return F.lower(stripped(F.translate(c, "\\", "/")))


def stem(path: Column) -> Column:
    """File name without folders and .md."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def est_tokens(c: Column) -> Column:
    """0 for blank text, else a quarter of its characters, one at least."""
    return F.when(stripped(F.coalesce(c, F.lit(""))) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).cast("int")


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores of the folded text, underscores at the ends stripped."""
    found = F.regexp_extract_all(fold_letters(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, "^_+|_+$", ""))


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index, which also splits at underscores."""
    return F.regexp_extract_all(fold_letters(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexical_terms(c: Column, limit: int = 32) -> Column:
    """Distinct search terms of a question: no stop words, two characters at least unless digits, the first `limit`."""
    words = F.filter(tokens(c), lambda t: (t != "") & ~t.isin(*STOPWORDS) & ((F.length(t) >= 2) | t.rlike("^[0-9]+$")))
    return F.slice(F.array_distinct(words), 1, limit)


def parse_date(c: Column) -> Column:
    """Y-M-D, D-M-Y, Y-M, Y, with - or /, or an ISO datetime; null for anything else."""
    t = F.replace(stripped(c), F.lit("/"), F.lit("-"))
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d")),
        F.when(t.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(t, "d-M-yyyy")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(t, F.lit("-1")), "yyyy-M-d")),
        F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-1-1")), "yyyy-M-d")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")),
    )
