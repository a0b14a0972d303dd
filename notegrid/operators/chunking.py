"""Notes to sections and chunks. Notes differ in size by far, so deal them out evenly before (repartition by path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import chunk_array, family_array, section_array
from ..params import DEFAULTS


def split_sections(notes: DataFrame, body: str = "body") -> DataFrame:
    """One row a section: section_index, heading, content. Rows of empty notes go."""
    return notes.select("*", F.posexplode(section_array(F.col(body)))).select(
        *notes.columns, F.col("pos").alias("section_index"), F.col("col.heading").alias("heading"), F.col("col.content").alias("content")
    )


def chunk_notes(notes: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, body: str = "body") -> DataFrame:
    """One row a chunk: chunk_index, heading, content."""
    return notes.select("*", F.posexplode(chunk_array(F.col(body), size, overlap))).select(
        *notes.columns, F.col("pos").alias("chunk_index"), F.col("col.heading").alias("heading"), F.col("col.content").alias("content")
    )


def chunk_parent_child(
    notes: DataFrame,
    key: str,
    parent: int = DEFAULTS.parent_size,
    child: int = DEFAULTS.child_size,
    overlap: int = DEFAULTS.child_overlap,
    body: str = "body",
) -> tuple[DataFrame, DataFrame]:
    """(parents, children) with key; the overlap is at most half a child. Both indexes run across the note."""
    families = notes.select(F.col(key), family_array(F.col(body), parent, child, min(overlap, child // 2)).alias("f"))
    parents = families.select(key, F.posexplode("f")).select(
        key, F.col("pos").alias("parent_index"), F.col("col.heading").alias("heading"), F.col("col.content").alias("content")
    )
    flat = F.flatten(
        F.transform(
            "f",
            lambda p, i: F.transform(p["children"], lambda c: F.struct(p["heading"].alias("heading"), c.alias("content"), i.alias("parent_index"))),
        )
    )
    children = families.select(key, F.posexplode(flat)).select(key, F.col("pos").alias("chunk_index"), "col.heading", "col.content", "col.parent_index")
    return parents, children
