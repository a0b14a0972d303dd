"""Places that driver and executors share, and small results that several branches of a plan start from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; without it there is no such place."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder: later branches read it instead of computing it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: str, sums: tuple[str, ...]) -> DataFrame:
    """df (of distinct values of order) with prev and next, the neighbours' values, and for each of sums its sum over smaller values (_before) and over all (_all).

    Rows are dealt by ranges of order and written once; a task sees one range, and what comes before a
    range follows from one row for each range.
    """
    dealt = kept(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("__range").agg(F.min(order).alias("__least"), F.max(order).alias("__most"), *[F.sum(c).alias(f"__{c}") for c in sums])
    by_range = Window.orderBy("__least")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    every = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "__range", F.lag("__most").over(by_range).alias("__prev"), F.lead("__least").over(by_range).alias("__next"),
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_start") for c in sums],
        *[F.sum(f"__{c}").over(every).alias(f"{c}_all") for c in sums],
    )
    inside = Window.partitionBy("__range").orderBy(order)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*", F.lag(order).over(inside).alias("__lag"), F.lead(order).over(inside).alias("__lead"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"__{c}_local") for c in sums]
    )
    return local.join(F.broadcast(ranges), "__range").select(  # one row a range
        *df.columns, F.coalesce("__lag", "__prev").alias("prev"), F.coalesce("__lead", "__next").alias("next"),
        *[(F.col(f"__{c}_start") + F.col(f"__{c}_local")).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums],
    )
