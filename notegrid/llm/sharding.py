"""Proportional stratified interleaving of documents into shards, in DataFrame operations only.

Rows of a stratum are put in a seeded random order; row r of n gets the fraction (2r + 1) / 2n.
All rows sorted by that fraction form one sequence in which every stretch has the mixture of the
whole, and equal cuts of the sequence are the shards. Both ranks are exact and neither needs a
sort in one task: each order is cut in buckets, counts of the buckets give the rank at which a
bucket starts, and row_number() counts on inside a bucket. The counts are summed in two levels, within
blocks of buckets and over blocks. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Buckets of a block, whose counts are summed in one task.
BLOCK = 4096


def summed_before(counts: DataFrame, order: str, value: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """counts with name, the sum of value over the rows of the same keys with a smaller order (one row for each keys and order).

    A task sees the rows of one block of orders; then, for all rows of the same keys, one row a block.
    """
    blocked = counts.withColumn("__block", F.expr(f"{order} div {BLOCK}"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum")).select(*keys, "__block", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__start"))
    local = blocked.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(sums, [*keys, "__block"]).withColumn(name, F.col("__start") + F.col("__local")).drop("__block", "__local", "__start")


def interleaved_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    rows_per_bucket: int = 5_000,
) -> DataFrame:
    """One row per row of docs: doc_id, stratum, size, text_crc32, position, shard, slot.

    Law: row counts of two shards differ by one at most; within a shard slots run from 0 without
    gaps. A null stratum is a stratum of its own; a null text counts as empty, long ones count whole;
    rows with null and repeated ids are told apart by their text, exact ties come in any order (they
    are equal rows). An empty table gives no rows. Other columns of docs are not looked at. With fewer
    rows than shards some shards stay empty. Equal texts may lie in several shards.
    """
    total = docs.count()
    buckets = max(shards, -(-total // rows_per_bucket))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), 1)).withColumn("hb", F.expr(f"shiftright(shiftright(u, 32) * {buckets}L, 31)"))

    counts = rows.groupBy("stratum", "hb").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    groups = summed_before(counts, "hb", "c", "first", ("stratum",)).join(sizes, "stratum").select("stratum", "hb", "c", "first", "n")

    # How many rows of a group fall in each bucket of fractions follows from its first rank and count.
    bucket_of = "((2 * ({r}) + 1) * {b}L) div (2 * n)"
    ranks_below = "(((2 * n * ({x}) - 1) div {b}L) + 1) div 2"
    spread = groups.select(
        "*",
        F.explode(F.expr(f"sequence({bucket_of.format(r='first', b=buckets)}, {bucket_of.format(r='first + c - 1', b=buckets)})")).alias("fb"),
    ).select(
        "fb",
        F.expr(
            f"least({ranks_below.format(x='fb + 1', b=buckets)}, first + c) - greatest({ranks_below.format(x='fb', b=buckets)}, first)"
        ).alias("c"),
    )
    starts = summed_before(spread.groupBy("fb").agg(F.sum("c").alias("c")), "fb", "c", "start").select("fb", "start")

    in_group = Window.partitionBy("stratum", "hb").orderBy("u", "doc_id", "size", "text_crc32")
    ranked = (
        rows.withColumn("rn", F.row_number().over(in_group))
        .join(groups.select("stratum", "hb", "first", "n"), ["stratum", "hb"])
        .withColumn("r", F.col("first") + F.col("rn") - 1)
        .select("doc_id", "stratum", "size", "text_crc32", "r", "n", F.expr(bucket_of.format(r="r", b=buckets)).alias("fb"))
    )
    in_bucket = Window.partitionBy("fb").orderBy((2 * F.col("r") + 1) / (2 * F.col("n")), "stratum", "r")
    placed = (
        ranked.withColumn("rn", F.row_number().over(in_bucket))
        .join(starts, "fb")
        .withColumn("position", F.col("start") + F.col("rn") - 1)
        .withColumn("shard", F.expr(f"(position * {shards}L) div {max(total, 1)}L"))
    )
    return placed.select(
        "doc_id",
        "stratum",
        "size",
        "text_crc32",
        "position",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"),
    )
