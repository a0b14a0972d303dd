"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that Python hands back; keeps large outputs in small pieces.
OUT_ROWS = 1000


def hash_sample(df: DataFrame, seed: int, keys: list[str], n: int) -> DataFrame:
    """n rows of df (all, if it has fewer), those of the least seeded hash of keys: the same at every run.

    df is counted first and rows that cannot be among them by far are left out where they are, so
    that the final order sees little more than n rows however many tasks there are.
    """
    total = df.count()
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 1)
    share = min(1.0, (1.2 * n + 200) / max(total, 1))
    most = min(int(share * (1 << 63)), (1 << 63) - 1)
    return df.filter(order <= F.lit(most)).orderBy(order, *keys).limit(n)


class Remembered(dict):
    """A dict that computes what it lacks and keeps the last `limit` to 2 * `limit` keys that were asked for."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable in the folder of spark.checkpoint.dir, which driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder)


def per_text(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    worker: Callable[[], Callable[[list[str]], list[pa.Array]]],
    schema: pa.Schema,
) -> DataFrame:
    """Runs a function over every whole text (null: empty), Arrow batch by Arrow batch.

    worker() is called once per task and returns a function from a list of texts to one Arrow
    array for each field of schema. The result has the id under its own name, then those fields.
    """
    id_type = docs.schema[id_col].dataType
    fields = [pa.field(f.name, f.type) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = worker()
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(apply(texts), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=[id_col, *(f.name for f in fields)])
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import from_arrow_schema
    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField(id_col, id_type), *from_arrow_schema(schema).fields])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read back."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{re.sub(r'[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be sent to all executors (a few MB); more are joined by a shuffle.
SENT_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in the only column of ids; rows with a null id stay.

    The ids are counted first. If they are few they are broadcast and the texts stay where they
    are; if not, both sides are shuffled.
    """
    shared_checkpoints(docs.sparkSession)
    gone = ids.toDF("__gone").distinct().checkpoint()
    side = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(side, docs[id_col] == F.col("__gone"), "left_anti")
