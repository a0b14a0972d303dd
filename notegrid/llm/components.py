"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes whose minimum is broadcast (16 MB); with more, both sides are shuffled, each node in SALTS pieces.
SENT_NODES, SALTS = 1_000_000, 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour goes to the smallest one. Small: every smaller neighbour and the node do."""
    if large:
        sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sym.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").checkpoint()
    if least.count() <= SENT_NODES:
        joined = sym.join(F.broadcast(least), "u", "left")
    else:  # a hub has many rows, so its minimum is copied and they are dealt by neighbour too
        copies = least.withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = sym.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "s"], "left")
    joined = joined.select("u", "v", F.coalesce("m", "u").alias("m"))
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the ends of edges (a, b long); checkpointed.

    Only counts come to the driver. Minima are aggregated before they are shuffled; those that change
    anything are counted and broadcast if they are few, else salted, so the rows of a hub are never in
    one task. No edges give no rows; loops are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    mark = None
    while True:
        after = _star(_star(now, True), False).checkpoint()
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if got == mark or not got[0]:
            break
        mark = got
    # stable: every edge leads from a node to the smallest node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
