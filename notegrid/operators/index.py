"""Keeping an index: change sets, upserts, validation, fingerprints, statistics, vector hygiene."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped


def diff_notes(new: DataFrame, old: DataFrame) -> DataFrame:
    """path and change (new, changed, unchanged, deleted) by path and sha256: one outer join."""
    n = new.select("path", F.col("sha256").alias("new_hash"), F.lit(True).alias("in_new"))
    o = old.select("path", F.col("sha256").alias("old_hash"), F.lit(True).alias("in_old"))
    change = (
        F.when(F.col("in_old").isNull(), "new")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged")
        .otherwise("changed")
    )
    return n.join(o, "path", "full_outer").select("path", change.alias("change"))


def diff_counts(changes: DataFrame) -> DataFrame:
    is_ = lambda *k: F.count_if(F.col("change").isin(*k))
    return changes.agg(
        is_("new", "changed", "unchanged").alias("scanned"),
        is_("new", "changed").alias("indexed"),
        is_("unchanged").alias("unchanged"),
        is_("deleted").alias("deleted"),
    )


def apply_diff(old: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """A table of the index after a change set: rows of changed and deleted paths go, fresh rows of new and changed ones come.

    The same call serves documents and everything below them (parents, chunks, links), as long as
    they carry the path.
    """
    gone = changes.filter(F.col("change").isin("changed", "deleted")).select(F.col("path").alias(key))
    come = changes.filter(F.col("change").isin("new", "changed")).select(F.col("path").alias(key))
    return old.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def validate_index(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """check, expected, actual, ok: row counts, children without their parent, and full-text rows against chunks."""
    checks = [
        df.agg(F.count("*").alias("actual")).select(F.lit(f"count {name}").alias("check"), F.lit(expected[name]).cast("long").alias("expected"), "actual")
        for name, df in sorted(tables.items())
        if name in expected
    ]
    if {"chunks", "parents"} <= tables.keys():
        children = tables["chunks"].filter(F.col("parent_index").isNotNull())
        lost = children.join(tables["parents"].select("path", "parent_index"), ["path", "parent_index"], "left_anti")
        checks.append(lost.agg(F.count("*").alias("actual")).select(F.lit("orphan children").alias("check"), F.lit(0).cast("long").alias("expected"), "actual"))
    if {"chunks", "fulltext_members"} <= tables.keys() and "chunk_id" in tables["chunks"].columns:
        chunks, members = tables["chunks"].select("chunk_id"), tables["fulltext_members"].select("chunk_id")
        zero = F.lit(0).cast("long").alias("expected")
        checks.append(members.agg(F.count("*").alias("actual")).join(chunks.agg(F.count("*").alias("expected"))).select(F.lit("full-text rows").alias("check"), "expected", "actual"))  # one row each
        checks.append(chunks.join(members, "chunk_id", "left_anti").agg(F.count("*").alias("actual")).select(F.lit("chunks without full text").alias("check"), zero, "actual"))
        checks.append(members.join(chunks, "chunk_id", "left_anti").agg(F.count("*").alias("actual")).select(F.lit("full text without chunks").alias("check"), zero, "actual"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def fingerprint(conf: Mapping[str, object]) -> str:
    """Canonical JSON of a configuration."""
    return json.dumps(conf, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def changed_fields(old: str, new: str) -> list[str]:
    """Names that differ between two fingerprints; any of them means a full rebuild."""
    a, b = json.loads(old), json.loads(new)
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def fingerprint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same over tables of (field, value): field, old_value, new_value of what differs."""
    o, n = old.select("field", F.col("value").alias("old_value")), new.select("field", F.col("value").alias("new_value"))
    return o.join(n, "field", "full_outer").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def index_stats(tables: Mapping[str, DataFrame], vectors: DataFrame) -> DataFrame:
    """One row: rows of each table and the sorted distinct dimensions of the vectors."""
    dims = vectors.agg(F.sort_array(F.collect_set(F.size("embedding"))).alias("dims"))
    out = dims
    for name, df in sorted(tables.items()):
        out = out.join(F.broadcast(df.agg(F.count("*").alias(f"n_{name}"))))  # one row each
    return out


def status_counts(notes: DataFrame) -> DataFrame:
    return notes.filter(stripped("status") != "").groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def tag_counts(notes: DataFrame, key: str = "doc_id") -> DataFrame:
    return notes.select(key, F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct(key).alias("n")).orderBy("tag")


def validity_states(notes: DataFrame) -> DataFrame:
    return notes.select("validity").distinct().orderBy("validity")


def validate_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows with a finite vector of the dimension that most rows have (the smaller one at a tie)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter((F.size(v) > 0) & finite)
    sizes = good.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).select("dim")
    return good.join(F.broadcast(top), F.size(v) == F.col("dim"), "left_semi")  # one row

