"""Notes as typed columns: frontmatter, title, status, tags, links, callouts, validity, embedding input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import blocks_meta
from ..functions.text import bound, est_tokens, fold_letters, parse_date, stem, stripped
from ..params import DEPRECATION_CALLOUTS, REVIEW_KEYS, VALID_FROM_KEYS, VALID_UNTIL_KEYS

# Patterns that define the note format.
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"
LINK = r"(!?)\[\[([^\]]+)\]\]"
TAG = r"(?<![\p{L}\p{N}_&])#([A-Za-zÀ-ɏ][\p{L}\p{N}_À-ɏ/-]*)"
# Escapes in double quotes.
ESCAPES = (("\\\\", "\u0002"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\/", "/"), ("\u0002", "\\"))
#: Separates the items of a list while lines are taken apart.
ITEM = "\u0001"
# Prefixes that embedding models expect before a text.
PREFIXES = {"none": "", "nomic": "search_document: ", "e5": "passage: ", "bge": ""}
PREFIX_RULES = (("nomic-embed", "nomic"), ("multilingual-e5", "e5"), ("intfloat/e5", "e5"), ("e5-", "e5"), ("bge-", "bge"), ("bge:", "bge"))


def _scalar(c: Column) -> Column:
    """A value as YAML reads it: quotes taken off, comments dropped from what is not quoted, '' for null."""
    t = stripped(c)
    double = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)
    for mark, to in ESCAPES:  # a backslash of its own waits behind a mark until the others are done
        double = F.replace(double, F.lit(mark), F.lit(to))
    single = F.replace(F.regexp_extract(t, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    plain = stripped(F.regexp_replace(t, r"(?:^|\s)#.*$", ""))
    return F.when(t.startswith('"'), double).when(t.startswith("'"), single).when(F.lower(plain).isin("null", "~"), "").otherwise(plain)


def _items(c: Column) -> Column:
    """The items of `[a, b]` (commas in quotes are not borders) or of lines that begin with a hyphen."""
    t = stripped(c)
    inner = F.regexp_replace(t, r"^\[(.*)\]\s*(?:#.*)?$", "$1")
    flow = F.split(inner, r""",(?=(?:[^"']*["'][^"']*["'])*[^"']*$)""")
    parts = F.when(F.contains(t, F.lit(ITEM)), F.split(t, ITEM)).otherwise(flow)
    return F.filter(F.transform(parts, _scalar), lambda v: v != "")


def parse_frontmatter(notes: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds metadata (map; lists as a comma-joined string), lists (map of the keys that have lists) and body.

    Flat `key: value`, `key: [a, b]` and `- item` lines under a key; lines that are comments do not
    count. Text without a block at its very start is all body with empty maps; a block with a line that is none of
    these has the key _yaml_error and no other. Of keys that repeat the last counts.
    """
    # Each step is evaluated once a row: a column that a lambda or a later column names more than once is bound first.
    keyed = r"^([^:\x01]+):(?=[\s\x01]|$)"
    value = lambda x: F.regexp_replace(x, keyed, "")

    def lines_of(front: Column) -> Column:
        spoken = F.array_join(F.filter(F.split(front, "\n"), lambda x: (stripped(x) != "") & ~x.rlike(r"^\s*#")), "\n")
        return F.split(F.regexp_replace(spoken, r"\n[ \t]*-[ \t]+", ITEM), "\n")  # items join the line of their key

    def pair(x: Column) -> Column:
        key, plain, items = _scalar(F.regexp_extract(x, keyed, 1)), _scalar(value(x)), _items(value(x))
        listed = value(x).rlike(r"\x01|^\s*\[.*\]\s*(?:#.*)?$")
        as_list = lambda i: F.struct(key.alias("key"), F.array_join(i, ", ").alias("value"), i.alias("items"))
        single = F.struct(key.alias("key"), plain.alias("value"), F.lit(None).cast("array<string>").alias("items"))
        return F.when(listed, bound(items, as_list)).otherwise(single)

    def latest(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))

    def read(lines: Column) -> Column:
        broken = F.exists(lines, lambda x: (x != "") & ~x.rlike(keyed))
        pairs = F.transform(F.filter(lines, lambda x: x.rlike(keyed)), pair)
        return F.struct(broken.alias("broken"), bound(pairs, latest).alias("latest"))

    def maps(whole: Column) -> Column:
        """Both maps of a text whose block is whole ('' if there is none)."""
        none = F.struct(F.create_map().cast("map<string,string>").alias("metadata"), F.create_map().cast("map<string,array<string>>").alias("lists"))
        error = F.struct(F.create_map(F.lit("_yaml_error"), F.lit("true")).alias("metadata"), F.create_map().cast("map<string,array<string>>").alias("lists"))
        entries = lambda p, field: F.map_from_entries(F.transform(p, lambda x: F.struct(x["key"].alias("key"), x[field].alias("value"))))
        good = lambda p: F.struct(entries(p, "value").alias("metadata"), entries(F.filter(p, lambda x: x["items"].isNotNull()), "items").alias("lists"))
        found = bound(bound(lines_of(F.regexp_extract(whole, FRONT, 1)), read), lambda r: F.when(r["broken"], error).otherwise(good(r["latest"])))
        return F.when(whole != "", found).otherwise(none)

    return (
        notes.withColumn("__maps", bound(F.regexp_extract(raw, FRONT, 0), maps))
        .withColumns({"metadata": F.col("__maps.metadata"), "lists": F.col("__maps.lists")})
        .withColumn("body", F.coalesce(bound(F.col(raw), lambda x: F.substring(x, F.length(F.regexp_extract(x, FRONT, 0)) + 1, F.length(x))), F.lit("")))
        .drop("__maps")
    )


def _meta(key: str) -> Column:
    return F.nullif(stripped(F.col("metadata")[key]), F.lit(""))


def with_title_status(notes: DataFrame) -> DataFrame:
    """title: first of titulo, title, nombre, the first # heading, the file stem. status: estado, or status if there is no estado."""
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit(""))
    own = bound(F.col("metadata"), lambda m: F.when(F.map_contains_key(m, F.lit("estado")), m["estado"]).otherwise(m["status"]))
    return notes.withColumn("title", F.coalesce(_meta("titulo"), _meta("title"), _meta("nombre"), heading, stem(F.col("path")))).withColumn(
        "status", F.lower(stripped(F.coalesce(own, F.lit(""))))
    )


def extract_blocks_meta(notes: DataFrame) -> DataFrame:
    """Adds callouts, anchors, deprecated, odd_fences, plain (no fenced code) and no_code (no inline code either)."""
    odd = lambda mark: F.regexp_count("body", F.lit(mark)) % 2 == 1
    return (
        notes.withColumn("m", blocks_meta(F.col("body")))
        .select("*", "m.callouts", "m.anchors", "m.plain", "m.no_code")
        .drop("m")
        .withColumn("deprecated", F.exists("callouts", lambda c: c["kind"].isin(*DEPRECATION_CALLOUTS)))
        .withColumn("odd_fences", odd("```") | odd("~~~"))
    )


def _clean_tag(c: Column) -> Column:
    return F.regexp_replace(fold_letters(stripped(c)), "^[/#-]+|[/#-]+$", "")


def extract_tags(notes: DataFrame) -> DataFrame:
    """tags: those of the frontmatter (tags, or etiquetas if there is no such key), then inline ones outside code; folded, distinct, in order.

    A list is taken item by item, a plain value is split at commas and spaces. Needs plain, metadata and lists.
    """
    own = lambda key: F.coalesce(F.col("lists")[key], F.split(F.col("metadata")[key], r"[,\s]+"))
    listed = F.when(F.map_contains_key("metadata", F.lit("tags")), own("tags")).otherwise(own("etiquetas"))
    both = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.regexp_extract_all("plain", F.lit(TAG), F.lit(1)))
    return notes.withColumn("tags", F.filter(F.array_distinct(F.transform(both, _clean_tag)), lambda t: t != ""))


def extract_links(notes: DataFrame) -> DataFrame:
    """links: array<struct<target, section, alias, embedded>>, distinct in order, outside code. Needs no_code."""
    whole = F.regexp_extract_all("no_code", F.lit(LINK), F.lit(0))

    def link(x: Column) -> Column:
        inner = F.replace(stripped(F.regexp_extract(x, LINK, 2)), F.lit("\\|"), F.lit("|"))
        parts = F.split(inner, r"\|", 2)
        place = F.split(parts[0], "#", 2)
        return F.struct(
            stripped(place[0]).alias("target"),
            stripped(F.coalesce(F.get(place, F.lit(1)), F.lit(""))).alias("section"),
            stripped(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("alias"),
            F.startswith(x, F.lit("!")).alias("embedded"),
        )

    return notes.withColumn("links", F.filter(F.array_distinct(F.transform(whole, link)), lambda x: x["target"] != ""))


def with_validity(notes: DataFrame, today: dt.date) -> DataFrame:
    """valid_from, valid_until, review, validity and review_overdue as of today. Needs metadata and deprecated."""
    first = lambda keys: F.coalesce(*[parse_date(F.col("metadata")[k]) for k in keys])
    now = F.lit(today)
    out = notes.withColumn("valid_from", first(VALID_FROM_KEYS)).withColumn("valid_until", first(VALID_UNTIL_KEYS)).withColumn("review", first(REVIEW_KEYS))
    state = (
        F.when(F.col("valid_until") <= now, "caducada")
        .when(F.col("valid_from") > now, "futura")
        .when(F.coalesce("valid_from", "valid_until", "review").isNotNull(), "vigente")
        .otherwise("desconocida")
    )
    return out.withColumn("validity", F.when(F.col("deprecated") & (state != "futura"), "caducada").otherwise(state)).withColumn(
        "review_overdue", F.coalesce(F.col("review") <= now, F.lit(False))
    )


def prefix_scheme(model: str, configured: str = "auto") -> str:
    wanted = configured.strip().casefold()
    if wanted not in ("", "auto"):
        if wanted not in PREFIXES:
            raise ValueError(f"unknown prefix scheme: {configured}")
        return wanted
    return next((s for needle, s in PREFIX_RULES if needle in model.strip().casefold()), "none")


def embedding_text(chunks: DataFrame, scheme: str = "none") -> DataFrame:
    """Adds embedding_input and its est_tokens. Needs title, heading, content, tags and callouts."""
    notes = F.transform(
        "callouts",
        lambda c: F.concat(F.lit("Aviso ("), c["kind"], F.lit("): "), F.coalesce(F.nullif(c["title"], F.lit("")), c["kind"])),
    )
    tag_line = F.when(F.size("tags") > 0, F.array(F.concat(F.lit("Etiquetas: "), F.array_join("tags", ", ")))).otherwise(F.array().cast("array<string>"))
    extra = F.array_join(F.concat(tag_line, notes), "\n")
    text = F.concat(
        F.lit(PREFIXES[scheme] + "Título: "), F.col("title"), F.lit("\nSección: "), F.col("heading"), F.lit("\n\n"), F.col("content"),
        F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""),
    )
    return chunks.withColumn("embedding_input", text).withColumn("est_tokens", est_tokens(F.col("embedding_input")))


def parsed_notes(raw_notes: DataFrame, today: dt.date) -> DataFrame:
    """All note columns from (path, raw)."""
    out = extract_blocks_meta(with_title_status(parse_frontmatter(raw_notes)))
    return with_validity(extract_links(extract_tags(out)), today)
