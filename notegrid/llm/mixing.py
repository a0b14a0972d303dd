"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source gets a target of words. Its documents, in a seeded random order and again in another one for a
second pass, form a stream of words that is cut in blocks of equal length. The mix is a sequence of slots, one
for each block: the unit interval is divided among the sources by their blocks (the cumulative weights), and slot t
belongs to the source whose part holds the t-th van der Corput point, t with its bits reversed. The points
of 2^m slots are the multiples of 2^-m, each once, so a source with b blocks owns b neighbouring points and gets b slots,
spread evenly over the mix; the r-th slot of a source takes its r-th block. Points beyond the last block stay unused.
The last block of a source is cut at its target.

All ranks and sums over more than a task's rows are taken in two levels (`running`): within partitions of a sorted
table, then over one row a partition. Texts are read once, for their sizes, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A word with the white space that follows it, and white space.
WORD, SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", " \t\n\x0b\x0c\r"


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """rows with, for each new name, the sum of a column over all rows that come earlier in the order (any order among ties).

    The rows are sorted over all partitions and written with their place; a window in each partition and the sums of
    earlier partitions (one row each) give the result.
    """
    placed = saved(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part)
        .agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        .select("__part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    )
    return (
        placed.withColumn("__part", part)
        .withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
        .join(F.broadcast(starts), "__part")  # a row for each partition of the sort
        .withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
        .drop("__at", "__part", *(f"__{n}" for n in sums))
    )


def targets(sources: DataFrame, percent: int, most_times: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight, target and number, the rank of the source by code point, null last.

    Targets share percent hundredths of all sizes by weight, up to most_times the size of their source; the excess
    of a source that stops is shared by the others in the same way. So a source's target is its cap, or its weight times one
    level: in the order of cap over weight the capped sources come first, and the level is what
    the capped ones before leave, divided by the weights that remain.
    """
    # sorted as strings: the bytes of UTF-8 sort like code points
    numbered = running(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"number": "one"}, "sources").drop("one")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    capped = numbered.withColumns({"weight": weight, "cap": F.col("source_size") * most_times})
    totals = capped.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    ordered = running(capped, [F.col("cap") / F.col("weight"), F.col("number")], {"caps_before": "cap", "weights_before": "weight"}, "caps")
    level = (F.col("all_size") * percent / 100 - F.col("caps_before")) / (F.col("all_weight") - F.col("weights_before"))
    levelled = ordered.crossJoin(F.broadcast(totals)).withColumn("level", level)  # totals is one row
    # the first source that its level does not fill sets the level of all after it
    chosen = levelled.filter(F.col("level") * F.col("weight") < F.col("cap")).agg(
        F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "number")).alias("final")
    )
    share = F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))
    return levelled.crossJoin(F.broadcast(chosen)).select(
        "source", "source_size", "number", "weight", F.coalesce(share, F.col("cap").cast("double")).alias("target")
    )


def _reversed_bits(value: Column, bits: Column) -> Column:
    """The lowest `bits` bits of a non-negative long (bits up to 62) in reverse."""
    return F.conv(F.rpad(F.reverse(F.bin(value)), bits, "0"), 2, 10).cast("long")


def mix(
    docs: DataFrame,
    percent: int = 150,
    most_times: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = 1024,
    seed: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces).

    documents: row_key, doc_id, source, size, source_size, target for every row of docs, written once; row_key numbers the rows. slots: slot
    (the place in the mix), number, rank. pieces: slot, row_key, part (the pass), first_word, words: what the
    slot takes from the document; the pieces of a slot follow each other in the order of `at`.

    The size of a text is its number of words, none for null; long texts count whole. A null source is a
    source of its own and comes last. Rows with null or repeated ids are rows of their own. Rows of
    equal id and size may stand for each other. The order is that of md5(seed, pass, id, size), so reruns agree.
    A source takes round(target) words; one whose words are none takes none. Empty tables give empty ones; other columns of docs are not looked at.
    """
    text = F.ltrim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPACE))
    size = F.length(F.regexp_replace(text, WORD, "x")).cast("long")
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    shares = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), percent, most_times, weights).withColumn("quota", F.round("target").cast("long")), "targets")
    # the table of sources is a file of known size now: Spark broadcasts it if it is small, else splits what is skewed
    named = rows.join(shares.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    blocks = shares.filter("quota > 0").select("number", "source_size", "quota", F.expr(f"(quota + {block_words - 1}) div {block_words}").alias("blocks"))
    owned = running(blocks, [F.col("number")], {"first_point": "blocks"}, "blocks")
    points = owned.agg(F.coalesce(F.max(F.col("first_point") + F.col("blocks")), F.lit(1)).alias("points")).select(F.length(F.bin(F.col("points") - 1)).alias("bits"))
    # a stretch of points a row, so that the points of a large source come from many tasks
    step = 8192
    stretches = owned.select("number", "first_point", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {step})")).alias("s")).repartition("number", "s")
    in_stretch = F.explode(F.expr(f"sequence(first_point + s * {step}, first_point + least(blocks, (s + 1) * {step}) - 1)"))
    slots = (
        stretches.select("number", in_stretch.alias("point"))
        .crossJoin(F.broadcast(points))  # points is one row
        .select("number", _reversed_bits(F.col("point"), F.col("bits")).alias("slot"), F.lit(1).cast("long").alias("one"))
    )
    # first_point is also the number of slots of all earlier sources
    ranked = (
        running(slots, [F.col("number"), F.col("slot")], {"place": "one"}, "slots")
        .join(owned.select("number", "first_point"), "number")
        .select("slot", "number", (F.col("place") - F.col("first_point")).alias("rank"))
    )

    passes = F.explode(F.expr("sequence(0L, (quota - 1) div source_size)")).alias("part")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("part").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    stream = named.filter("size > 0 AND quota > 0").select("row_key", "doc_id", "size", "number", "source_size", "quota", passes).withColumn("shuffled", order)
    at = running(stream, [F.col("number"), F.col("part"), F.col("shuffled"), F.col("doc_id"), F.col("size")], {"total": "size"}, "streams")
    starts = running(stream.groupBy("number").agg(F.sum("size").alias("words")), [F.col("number")], {"words_before": "words"}, "starts").select("number", "words_before")
    located = at.join(starts, "number").withColumn("start", F.col("total") - F.col("words_before")).withColumn("end", F.least(F.col("start") + F.col("size"), F.col("quota"))).filter("start < end")
    pieces = (
        located.withColumn("rank", F.explode(F.expr(f"sequence(start div {block_words}, (end - 1) div {block_words})")))
        .join(ranked, ["number", "rank"])
        .withColumn("at", F.greatest(F.col("start"), F.col("rank") * block_words))
        .select("slot", "at", "row_key", "part", (F.col("at") - F.col("start")).alias("first_word"), (F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.col("at")).alias("words"))
    )
    return named.select("row_key", "doc_id", "source", "size", "source_size", "target"), ranked, pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the row in the mix, repeats counted) for every row of docs."""
    rows, _, pieces = mix(docs, **how)
    got = pieces.groupBy("row_key").agg(F.sum("words").alias("taken"))
    return rows.join(got, "row_key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
