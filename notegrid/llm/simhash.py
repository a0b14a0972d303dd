"""SimHash near-duplicates with BK-trees over shards of fingerprints.

Two fingerprints within 4 bits agree in at least two of six blocks of their bits, so each distinct
fingerprint goes to the 15 shards of its pairs of blocks. A shard becomes a BK-tree (children keyed
by their Hamming distance to the parent) that is walked for all its fingerprints at once, down only
those edges that the radius allows. What leaves a shard is a spanning forest, not pairs; components
of all forests are those of all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Forest, compared
from .common import per_text, shared_checkpoints, without
from .components import components
from .shingles import similar_links

BITS = 64
#: Rows of a shard's piece, and so of a tree.
TREE_ROWS = 8192


def fingerprint(text: str, words_in_shingle: int = 4, seed: int = 42) -> int:
    """64 bits, set where over half of the shingles' XXH64 have the bit; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    n = max(1, len(words) - words_in_shingle + 1)
    to = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, to)), ">u8", n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id and fp, the fingerprint as a signed long. Null and empty texts: 0."""

    def worker():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return per_text(docs, id_col, text_col, worker, pa.schema([("fp", pa.int64())]))


class BKTree:
    """Over an array of distinct uint64; built by splitting the rows of a subtree by distance to its head."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children: list[list[tuple[int, int]]] = [[] for _ in prints]
        work = [np.arange(len(prints))]
        while work:
            rows = work.pop()
            rest = rows[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(prints[rest] ^ prints[rows[0]])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            for part in np.split(rest, np.flatnonzero(d[1:] != d[:-1]) + 1):
                edge = int(np.bitwise_count(prints[part[0]] ^ prints[rows[0]]))
                self.children[rows[0]].append((edge, int(part[0])))
                work.append(part)

    def within(self, queries: np.ndarray, radius: int):
        """(node, rows of queries within radius of it), for all nodes that have any."""
        work = [(0, np.arange(len(queries)))]
        while work:
            node, active = work.pop()
            d = np.bitwise_count(queries[active] ^ self.prints[node]).astype(np.int16)
            near = active[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                down = active[abs(d - edge) <= radius]
                if len(down):
                    work.append((child, down))


def shard_keys(fp: str, radius: int) -> list[str]:
    """SQL for the keys of the shards: two blocks of radius + 2, with their number on top."""
    n = radius + 2
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    block = [f"(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts, cuts[1:])]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    return [f"((({k}L << {width}) | {block[i]}) << {width}) | {block[j]}" for k, (i, j) in enumerate(combinations(range(n), 2))]


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable by links of at most radius bits.

    Every row of docs is kept; null and empty texts have the fingerprint 0 and link like any other.
    Rows that repeat an id each have their own fingerprint and count under that id. Rows with a null
    id keep a component_id only if a row with an id has their fingerprint. An empty table gives no
    rows; other columns are not looked at. Exact: no link is missed.
    """
    shared_checkpoints(docs.sparkSession)
    prints = fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), "fp").checkpoint()
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    keyed = classes.filter("rep IS NOT NULL").select(
        F.explode(F.array(*[F.expr(k) for k in shard_keys("fp", radius)])).alias("key"), F.col("fp"), F.col("rep").cast("long").alias("rep")
    )

    def compare(a: pa.RecordBatch, b: pa.RecordBatch | None):
        left, left_ids = a.column(0).to_numpy().view(np.uint64), a.column(1).to_numpy()
        right, ids = left, left_ids
        if b is not None:
            right = b.column(0).to_numpy().view(np.uint64)
            ids = np.concatenate([left_ids, b.column(1).to_numpy()])
        if len(left) == len(right) == 2 and b is None:
            if np.bitwise_count(left[0] ^ left[1]) > radius:
                return None
            return [pa.array(ids[1:]), pa.array(ids[:1])]
        forest, shift = Forest(len(ids)), 0 if b is None else len(left)
        for node, near in BKTree(left).within(right, radius):
            forest.link(np.append(near + shift, node))
        heads = forest.heads(ids)
        return [pa.array(ids[heads != ids]), pa.array(heads[heads != ids])]

    edges = compared(keyed, compare, pa.schema([("a", pa.int64()), ("b", pa.int64())]), TREE_ROWS)
    comps = components(edges)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", min_similarity: float | None = None
) -> DataFrame:
    """docs with one document of each component, that of the smallest id; all columns stay.

    Rows that repeat an id are one document. Rows with a null id stay. With min_similarity, texts
    whose five-word shingles are at least that similar (see shingles) are linked as well.
    """
    found = near_duplicates(docs, radius, id_col, text_col).filter("doc_id <> component_id")
    if min_similarity is None:
        return without(docs, found.select("doc_id"), id_col)
    near = found.select(F.col("doc_id").cast("long").alias("a"), F.col("component_id").alias("b"))
    linked = components(near.unionByName(similar_links(docs, min_similarity, id_col, text_col)))
    return without(docs, linked.filter("node <> component").select("node"), id_col)


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
