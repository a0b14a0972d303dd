"""An index in versions, of which a change set rewrites only the parts that it touches.

Every table that has a path is dealt to buckets by a hash of it. A version writes the buckets that hold changed paths,
and a manifest that says for each table and bucket which version wrote it. One line of the manifest makes the
version current, for all tables at once, and it is written last.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.index import apply_diff, validate_index

#: Buckets of a table; more of them make smaller files and finer rewriting.
BUCKETS = 256
MANIFEST = "version string, at timestamp, ordinal long, parts array<struct<name:string,bucket:int,wrote:string>>, schemas map<string,string>"


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, dest: str):
    manifest = spark.read.schema(MANIFEST).json(f"{dest}/manifest")
    return manifest.orderBy(F.desc("ordinal")).limit(1).first()


def open_index(spark: SparkSession, dest: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    now = _current(spark, dest)
    return {name: _table(spark, dest, now, name) for name in now.schemas}


def _table(spark: SparkSession, dest: str, version, name: str, buckets: set[int] | None = None) -> DataFrame:
    read = spark.read.schema(version.schemas[name])
    parts = [p for p in version.parts if p.name == name and (buckets is None or p.bucket in buckets)]
    if not parts:
        return spark.createDataFrame([], version.schemas[name])
    return read.parquet(*[f"{dest}/{p.wrote}/{name}" + (f"/bucket={p.bucket}" if p.bucket >= 0 else "") for p in parts])


def _write(df: DataFrame, dest: str, version: str, name: str, buckets: int) -> list[tuple[str, int, str]]:
    """Bucket -1 stands for a table without paths, which is written whole."""
    path = f"{dest}/{version}/{name}"
    if "path" not in df.columns:
        df.write.parquet(path)
        return [(name, -1, version)]
    dealt = df.withColumn("bucket", _bucket(F.col("path"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "path")
    dealt.write.partitionBy("bucket").parquet(path)
    written = df.sparkSession.read.schema(f"{_ddl(df)}, bucket int").parquet(path).select("bucket").distinct().collect()  # at most `buckets` rows
    return [(name, r.bucket, version) for r in written]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _switch(spark: SparkSession, dest: str, version: str, ordinal: int, parts: list, schemas: dict[str, str]) -> None:
    row = [(version, None, ordinal, parts, schemas)]
    spark.createDataFrame(row, MANIFEST).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{dest}/manifest")


def _checked(spark: SparkSession, dest: str, version: str, ordinal: int, parts: list, schemas: dict[str, str], expected: Mapping[str, int] | None, before) -> DataFrame:
    """Validates a version as it lies there, makes it current, and validates once more what is current then."""
    staged = Row(schemas=schemas, parts=[Row(name=n, bucket=b, wrote=w) for n, b, w in parts])
    tables = {name: _table(spark, dest, staged, name) for name in schemas}
    counts = dict(expected) if expected is not None else {name: df.count() for name, df in tables.items()}
    if not validate_index(tables, counts).filter(~F.col("ok")).isEmpty():
        raise ValueError(f"version {version} is not valid")
    _switch(spark, dest, version, ordinal, parts, schemas)
    checks = validate_index(open_index(spark, dest), counts)
    if not checks.filter(~F.col("ok")).isEmpty():
        if before is not None:  # the version before becomes current again
            _switch(spark, dest, before.version, ordinal + 1, [(p.name, p.bucket, p.wrote) for p in before.parts], before.schemas)
        raise ValueError(f"version {version} was not valid after it had become current")
    return checks


def create_index(spark: SparkSession, tables: Mapping[str, DataFrame], dest: str, buckets: int = BUCKETS, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Writes a first or a full version; returns its checks, or raises ValueError and leaves what was current."""
    version = f"v-{uuid.uuid4().hex}"
    parts = [p for name, df in tables.items() for p in _write(df, dest, version, name, buckets)]
    try:
        before = _current(spark, dest)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # else there is no manifest yet
            raise
        before = None
    return _checked(spark, dest, version, (before.ordinal + 1) if before else 1, parts, {n: _ddl(df) for n, df in tables.items()}, expected, before)


def upsert_index(
    spark: SparkSession, fresh: Mapping[str, DataFrame], changes: DataFrame, dest: str, buckets: int = BUCKETS, expected: Mapping[str, int] | None = None
) -> DataFrame:
    """Brings the index to a new version: rows of changed and deleted paths go from all tables, fresh rows of new and changed ones come.

    changes: path, change (`diff_notes`). Only buckets with such a path are read and written; the others stay where they are.
    Tables of fresh without a path (a full-text index) are written whole, and tables that fresh lacks lose the rows that go.
    buckets must be that of the version before.
    """
    before = _current(spark, dest)
    version = f"v-{uuid.uuid4().hex}"
    moved = changes.filter(F.col("change") != "unchanged").select("path", "change")
    touched = {r.bucket for r in moved.select(_bucket(F.col("path"), buckets).alias("bucket")).distinct().collect()}  # at most `buckets` rows
    parts: list[tuple[str, int, str]] = []
    schemas = dict(before.schemas)
    for name in sorted(schemas.keys() | fresh.keys()):
        new = fresh.get(name)
        if new is not None and "path" not in new.columns:
            parts += _write(new, dest, version, name, buckets)
            schemas[name] = _ddl(new)
            continue
        kept = [(p.name, p.bucket, p.wrote) for p in before.parts if p.name == name and p.bucket not in touched]
        parts += kept
        if name not in before.schemas:
            schemas[name] = _ddl(new)
        elif all(p.bucket < 0 for p in before.parts if p.name == name):
            continue
        if touched:
            old = _table(spark, dest, before, name, touched) if name in before.schemas else new.limit(0)
            parts += _write(apply_diff(old, (old.limit(0) if new is None else new).select(*old.columns), moved), dest, version, name, buckets)
    return _checked(spark, dest, version, before.ordinal + 1, parts, schemas, expected, before)
