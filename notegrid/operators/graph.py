"""The link graph: aliases, resolution, health, score propagation, expansion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import norm_path, stem, stripped
from ..params import DEFAULTS
from ..shared import kept

MAX_HOPS = 5
#: Arcs of a cell of the last hop on average, pairs that a task makes at once, targets in a run of arcs, and questions that meet all targets before the next ones.
ARCS_HELD, PAIRS, BLOCK, ASKED = 1_000_000, 250_000, 1024, 256


def _no_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md$", "")


def _claims(docs: DataFrame) -> DataFrame:
    path = norm_path(F.col("path"))
    names = F.array_distinct(F.array(F.lower(stripped("title")), _no_suffix(path), F.lower(stem(path))))
    return docs.select("doc_id", F.explode(F.filter(names, lambda a: a != "")).alias("alias"))


def alias_index(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """alias, doc_id: title, path without .md and file stem; the first claimant by doc_id wins."""
    return _claims(docs).groupBy("alias").agg(F.min("doc_id").alias("doc_id"))


def ambiguous_aliases(docs: DataFrame) -> DataFrame:
    return _claims(docs).groupBy("alias").agg(F.countDistinct("doc_id").alias("claimants")).filter("claimants > 1")


def resolve_links(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """links (source, pos, target, ...) with target_id: the target as it is, without .md, its stem; the first that is an alias, else null."""
    t = norm_path(F.col("target"))
    tries = F.array_distinct(F.array(t, _no_suffix(t), F.lower(stem(t))))
    keyed = links.filter(stripped("target") != "").select("source", "pos", F.posexplode(tries).alias("try", "alias"))
    hit = (
        keyed.join(aliases.select("alias", F.col("doc_id").alias("found")), "alias")
        .groupBy("source", "pos")
        .agg(F.min_by("found", "try").alias("target_id"))
    )
    return links.filter(stripped("target") != "").join(hit, ["source", "pos"], "left")


#: Bits of a Bloom filter for each alias, hash functions, and the most bits (8 MB).
BLOOM_BITS, BLOOM_HASHES, BLOOM_MOST = 12, 4, 1 << 26


def _bloom(names: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, 64-bit words) of a Bloom filter over the column name; words are put together by bit_or, at most BLOOM_MOST / 64 rows."""
    bits = min(BLOOM_MOST, max(64, 1 << (BLOOM_BITS * n).bit_length()))
    at = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(bits)) for seed in range(BLOOM_HASHES)))).alias("at")
    held = names.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held["word"].to_numpy()] = held["bits"].to_numpy()
    return bits, words


def _may_hold(names: Column, bits: int, words: Broadcast) -> Column:
    """Whether one of the names may be in the filter."""
    places = F.transform(names, lambda x: F.array(*(F.pmod(F.xxhash64(F.lit(seed), x), F.lit(bits)) for seed in range(BLOOM_HASHES))))

    @F.pandas_udf("boolean")
    def hit(rows: pd.Series) -> pd.Series:
        held = words.value
        return rows.map(lambda tries: any(all(held[p >> 6] >> (p & 63) & 1 for p in np.asarray(one).tolist()) for one in tries))

    return hit(places)


def reresolve(edges: DataFrame, aliases: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Tries broken edges again; edges that have a target keep it.

    With added (alias, doc_id), the aliases that a change set brought, only they are looked up: what was broken had no other.
    A Bloom filter of them leaves out the edges that cannot have a hit before anything is shuffled.
    """
    if added is not None:
        named = added.select("alias", "doc_id").distinct()
        n = named.count()
        if not n:
            return edges
        bits, words = _bloom(named.select(F.col("alias").alias("name")), n)
        t = norm_path(F.col("target"))
        possible = F.col("target_id").isNull() & _may_hold(F.array(t, _no_suffix(t), F.lower(stem(t))), bits, edges.sparkSession.sparkContext.broadcast(words))
        marked = edges.withColumn("__possible", F.coalesce(possible, F.lit(False)))
        tried = resolve_links(marked.filter("__possible").drop("__possible", "target_id"), named)
        return marked.filter("NOT __possible").drop("__possible").unionByName(tried.select(*edges.columns))
    broken = edges.filter(F.col("target_id").isNull()).drop("target_id")
    return edges.filter(F.col("target_id").isNotNull()).unionByName(resolve_links(broken, aliases).select(*edges.columns))


def graph_status(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total, resolved, broken, orphans, ambiguous."""
    good = edges.filter(F.col("target_id").isNotNull())
    ends = good.select(F.col("source").alias("doc_id")).union(good.select("target_id"))
    counts = edges.agg(
        F.count("*").alias("total"), F.count("target_id").alias("resolved"), F.count_if(F.col("target_id").isNull()).alias("broken")
    )
    orphans = docs.join(ends, "doc_id", "left_anti").agg(F.count("*").alias("orphans"))
    ambiguous = ambiguous_aliases(docs).agg(F.count("*").alias("ambiguous"))
    return counts.join(F.broadcast(orphans)).join(F.broadcast(ambiguous))  # one row each


def degree_stats(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """mean, median and max of resolved links out of a note, over all notes, and the note of the max (the smallest id at a tie)."""
    out = edges.filter(F.col("target_id").isNotNull()).groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("c"))
    per = docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("c", F.lit(0)).alias("c"))
    return per.agg(
        F.round(F.avg("c"), 6).alias("mean"),
        F.median("c").alias("median"),
        F.max("c").alias("max"),
        F.max_by("doc_id", F.struct("c", -F.col("doc_id"))).alias("max_doc"),
    )


def propagate(
    seeds: DataFrame,
    edges: DataFrame,
    hops: int = DEFAULTS.graph_hops,
    decay: float = DEFAULTS.graph_decay,
    backlink: float = DEFAULTS.graph_backlink,
    digits: int | None = None,
) -> DataFrame:
    """query_id, doc_id, graph_score, hop of documents reached from seeds (query_id, doc_id, weight).

    Best path, not the sum; along a link 1, against it `backlink`; only better values go on; seeds are
    never returned. At most five hops, more are refused. All hops but the last are one join and one aggregation each, written
    once; it ends when no value gets better. The last hop may reach most documents from most questions (a note that all link to),
    so its pairs are made where they are added up (`_last_hop`) and never shuffled or written. With digits, graph_score
    is rounded to so many, half up, after everything; the last hop rounds each distinct value once and no row.
    """
    if hops > MAX_HOPS:
        raise ValueError(f"at most {MAX_HOPS} hops")
    arcs = edges.select("source", "target", F.lit(1.0).alias("dir")).union(edges.select("target", "source", F.lit(float(backlink)))).filter("source IS NOT NULL AND target IS NOT NULL")
    best = seeds.filter("query_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("weight").alias("w")).withColumns({"hop": F.lit(0), "given": F.lit(True)})
    for hop in range(1, hops):
        step = (
            best.filter(F.col("hop") == hop - 1).join(arcs, F.col("doc_id") == F.col("source"))
            .select("query_id", F.col("target").alias("doc_id"), ((F.col("w") * F.lit(float(decay))) * F.col("dir")).alias("w"), F.lit(hop).alias("hop"), F.lit(False).alias("given"))
        )
        # values of earlier hops win ties; the union is added up where it lies before the shuffle
        whole = best.unionByName(step).groupBy("query_id", "doc_id").agg(F.max_by(F.struct("w", "hop"), F.struct("w", -F.col("hop"))).alias("b"), F.max("given").alias("given"))
        best = kept(whole.select("query_id", "doc_id", "b.w", "b.hop", "given"), f"hop-{hop}")  # the next hop starts from what this one wrote
        if best.filter(F.col("hop") == hop).isEmpty():
            break
    else:
        if hops > 0:
            return _last_hop(best, arcs, hops, float(decay), digits)
    score = F.col("w") if digits is None else F.round("w", digits)
    return best.filter("NOT given").select("query_id", "doc_id", score.alias("graph_score"), "hop")


def _last_hop(best: DataFrame, arcs: DataFrame, hop: int, decay: float, digits: int | None) -> DataFrame:
    """query_id, doc_id, graph_score, hop after one more hop from best (query_id, doc_id, w, hop, given).

    A cell is a block of questions and a block of targets: it has the arcs into its targets and what its questions
    reached, so every pair that it makes is final. What is shuffled is best and arcs, each copied for about the root of the number of cells;
    a task holds the arcs of one cell (ARCS_HELD on average at most) and streams over its questions. Rows come out by ASKED
    questions, in them by target: where most questions reach the same targets, what is written repeats within a page and packs to a small part.
    """
    cells = 4 * best.sparkSession.sparkContext.defaultParallelism
    down = max(math.isqrt(cells), -(-arcs.count() // ARCS_HELD))
    across = max(1, -(-cells // down))
    id_type = best.select("doc_id").union(arcs.select("target")).schema["doc_id"].dataType
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    start = best.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumn("home", own("doc_id", down))
    asked = start.withColumn("to", F.explode(F.when(F.col("hop") == hop - 1, each(down)).otherwise(F.array("home")))).select(
        (own("query_id", across) * down + F.col("to")).alias("cell"), F.lit(1).alias("kind"), "query_id", F.col("doc_id").alias("a"), F.lit(None).cast(id_type).alias("b"),
        F.col("w").cast("double").alias("w"), "hop", ((F.col("to") == F.col("home")) & F.lit(True)).alias("own"), "given",
    )
    ends = arcs.select(F.col("source").cast(id_type).alias("a"), F.col("target").cast(id_type).alias("b"), "dir").withColumn("from", F.explode(each(across)))
    reach = ends.select(
        (F.col("from") * down + own("b", down)).alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast(best.schema["query_id"].dataType).alias("query_id"), "a", "b",
        F.col("dir").alias("w"), F.lit(0).alias("hop"), F.lit(False).alias("own"), F.lit(False).alias("given"),
    )
    # one cell a task: a hash of so few numbers would give some tasks several and others none
    dealt = reach.unionByName(asked).repartitionById(down * across, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "query_id")
    out = StructType([best.schema["query_id"], StructField("doc_id", id_type), StructField("graph_score", DoubleType()), StructField("hop", IntegerType())])
    return dealt.mapInArrow(lambda batches: _cells(batches, hop, decay, digits), out)


def _cells(batches: Iterator[pa.RecordBatch], hop: int, decay: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, kind (arcs, then what is reached) and question."""
    cell, held, arcs, waiting = None, [], None, None
    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if cells[lo] != cell:
                if waiting:
                    yield from _reached(pa.Table.from_batches(waiting), arcs, hop, decay, digits)
                cell, held, arcs, waiting = cells[lo], [], None, []
            if kinds[lo] == 0:
                held.append(part.select(["a", "b", "w"]))
                continue
            if arcs is None:
                arcs, held = _Arcs(held), []
            # the last question may go on in the next batch
            asked = part.column("query_id").to_numpy(zero_copy_only=False)
            whole = int(np.argmax(asked == asked[-1]))
            if whole or (waiting and waiting[-1].column("query_id")[-1].as_py() != part.column("query_id")[0].as_py()):
                yield from _reached(pa.Table.from_batches([*waiting, part.slice(0, whole)]), arcs, hop, decay, digits)
                waiting = []
            waiting.append(part.slice(whole))
    if waiting:
        yield from _reached(pa.Table.from_batches(waiting), arcs, hop, decay, digits)


class _Arcs:
    """The arcs of a cell by source: numbers of targets in order, and which of the directions. A run has the arcs of a source into one block of targets."""

    def __init__(self, parts: list[pa.RecordBatch]):
        none = np.zeros(0, np.int64)
        self.sources, self.targets, self.target, self.way, self.block = none, none, none, none, none
        self.ways, self.first, self.start = np.zeros(0), np.zeros(1, np.int64), np.zeros(1, np.int64)
        if parts:
            t = pa.Table.from_batches(parts)
            self.sources, source = np.unique(t["a"].to_numpy(), return_inverse=True)
            self.targets, target = np.unique(t["b"].to_numpy(), return_inverse=True)
            self.ways, way = np.unique(t["w"].to_numpy(), return_inverse=True)
            order = np.lexsort((target, source))
            self.target, self.way, source = target[order], way[order], source[order]
            block = self.target // BLOCK
            runs = np.flatnonzero(np.concatenate([[True], (source[1:] != source[:-1]) | (block[1:] != block[:-1])]))
            self.block, self.start = block[runs], np.append(runs, len(source))
            self.first = np.searchsorted(source[runs], np.arange(len(self.sources) + 1))

    @staticmethod
    def find(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of ids in known, -1 for what is not there."""
        if not len(known):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, at, -1)


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each first on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where another key begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """As Spark's round, on the decimal digits of a value."""
    if digits is None:
        return values
    unit, exact = Decimal(1).scaleb(-digits), Context(prec=400)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP, exact)) if math.isfinite(x) else x for x in values.tolist()], np.float64)


def _reached(rows: pa.Table, arcs: _Arcs, hop: int, decay: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """What whole questions reach in a cell: by stretches of about PAIRS runs of arcs (a question with more stands alone), in them by ASKED questions, target and question."""
    asked, docs, w, hops, own, given = (rows[c].to_numpy() for c in ("query_id", "a", "w", "hop", "own", "given"))
    if not len(asked):
        return
    source = np.where(hops == hop - 1, _Arcs.find(arcs.sources, docs), -1)
    many = np.where(source >= 0, arcs.first[source + 1] - arcs.first[source], 0)
    home = _Arcs.find(arcs.targets, docs)
    starts = _heads(asked)
    before = (np.cumsum(many) - many)[starts] // PAIRS
    cuts = starts[_heads(before)]
    for lo, hi in zip(cuts, [*cuts[1:], len(asked)], strict=True):
        heads = lo + _heads(asked[lo:hi])
        number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, hi)))
        # few values are met, so pairs carry their ranks
        weights, weight = np.unique(w[lo:hi], return_inverse=True)
        values, rank = np.unique(((weights * decay)[:, None] * arcs.ways).ravel(), return_inverse=True)
        rank, shown, shown_before = rank.reshape(len(weights), -1), _rounded(values, digits), _rounded(weights, digits)
        blocks, m, r = len(arcs.targets) // BLOCK + 1, max(1, len(arcs.targets)), max(1, len(values))
        at = np.flatnonzero(many[lo:hi])
        n = many[lo:hi][at]
        run, question = _each(arcs.first[source[lo:hi][at]], n), np.repeat(number[at], n)
        group = question // ASKED * blocks + arcs.block[run]
        order = np.argsort(group, kind="stable")
        run, question, group, weight_of = run[order], question[order], group[order], np.repeat(weight[at], n)[order]
        size, key_of = arcs.start[run + 1] - arcs.start[run], question // ASKED * (m * ASKED) + question % ASKED
        # what was reached before, in the one cell of its document; -1: no arc of the cell leads there
        old = np.flatnonzero(own[lo:hi])
        old_key = np.where(home[lo:hi][old] >= 0, (number[old] // ASKED * m + home[lo:hi][old]) * ASKED + number[old] % ASKED, -1)
        order = np.argsort(old_key, kind="stable")
        old, old_key = old[order], old_key[order]
        begins = _heads(group)
        pieces = begins[_heads(((np.cumsum(size) - size)[begins]) // PAIRS)]
        olds = np.append(np.searchsorted(old_key, (group[pieces[1:]] // blocks * m + group[pieces[1:]] % blocks * BLOCK) * ASKED), len(old))
        ends = np.append(pieces[1:], len(run))
        for p, q, i, j in zip(*((pieces, ends, np.append(0, olds[:-1]), olds) if len(run) else ([0], [0], [0], [len(old)])), strict=True):
            arc, n = _each(arcs.start[run[p:q]], size[p:q]), size[p:q]
            pairs = np.sort((np.repeat(key_of[p:q], n) + arcs.target[arc] * ASKED) * r + rank[np.repeat(weight_of[p:q], n), arcs.way[arc]])
            key = pairs // r
            last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)  # the best value of a pair
            key, got = key[last], pairs[last] % r
            line = key // ASKED
            ids, reached = asked[heads[line // m * ASKED + key % ASKED]], arcs.targets[line % m]
            score, by = shown[got], np.full(len(key), hop, np.int32)
            # values of earlier hops win ties
            o = old[i:j]
            place = np.where(old_key[i:j] >= 0, _Arcs.find(key, old_key[i:j]), -1)
            met, alone = np.flatnonzero(place >= 0), o[(place < 0) & ~given[lo:hi][o]]
            stays = met[~(values[got[place[met]]] > w[lo:hi][o[met]])]
            score[place[stays]], by[place[stays]] = shown_before[weight[o[stays]]], hops[lo:hi][o[stays]]
            out = np.delete(np.arange(len(key)), place[met][given[lo:hi][o[met]]])
            # targets that most questions reach first: a missing question shifts the bits of what follows, which then does not repeat
            many_of = np.diff(np.append(_heads(line[out]), len(out)))
            out = out[np.argsort(np.repeat(many_of < many_of.max(initial=0), many_of), kind="stable")]
            columns = [c[out] for c in (ids, reached.astype(docs.dtype), score, by)]
            if alone.size:
                added = (asked[lo:hi][alone], docs[lo:hi][alone], shown_before[weight[alone]], hops[lo:hi][alone].astype(np.int32))
                columns = [np.concatenate(c) for c in zip(columns, added, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "graph_score", "hop"])


def seeds_of(semantic: DataFrame, n: int = DEFAULTS.graph_seeds) -> DataFrame:
    """The first n distinct documents of each query by semantic rank, with weight 1 / place."""
    first = semantic.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return first.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "doc_id", (F.lit(1.0) / F.col("place")).alias("weight"))


def graph_candidates(
    semantic: DataFrame, edges: DataFrame, similarities: DataFrame, n: int = DEFAULTS.graph_max_candidates, reached: DataFrame | None = None, **how
) -> DataFrame:
    """For each document reached its most similar chunk; the best n of a query by (graph score, similarity).

    similarities: query_id, chunk_id, doc_id, score of the chunks of reached documents. reached: what
    `propagate` gave, if it has been called before.
    """
    if reached is None:
        reached = propagate(seeds_of(semantic), edges, **how)
    chunk = similarities.join(reached, ["query_id", "doc_id"]).groupBy("query_id", "doc_id", "graph_score", "hop").agg(
        F.max_by(F.struct("chunk_id", "score"), F.struct("score", -F.col("chunk_id"))).alias("c")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("graph_score"), F.desc("similarity"), "chunk_id")
    return (
        chunk.select("query_id", "c.chunk_id", "doc_id", "graph_score", "hop", F.col("c.score").alias("similarity"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def expand_links(
    selected: DataFrame, links: DataFrame, chunks: DataFrame, limit: int = DEFAULTS.max_linked, factor: float = DEFAULTS.linked_factor, hits: int = 3
) -> DataFrame:
    """Chunks of notes that the first hits link to: query_id, place, chunk_id, doc_id, score, fusion.

    selected: query_id, rank, doc_id, score, fusion. links: source, pos, target_id, section. chunks:
    doc_id, chunk_id, chunk_index, heading. The chunk whose heading equals or holds the section comes
    first, else that of the lowest index; a document comes once, and none that is selected already.
    """
    found = (
        selected.filter(F.col("rank") <= hits)
        .select("query_id", "rank", F.col("doc_id").alias("source"), "score", "fusion")
        .join(links.filter(F.col("target_id").isNotNull()).select("source", "pos", F.col("target_id").alias("doc_id"), "section"), "source")
    )
    new = found.join(selected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    once = new.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("rank", "pos", "section", "score", "fusion"), F.struct("rank", "pos")).alias("l"))
    section, heading = F.lower(stripped("l.section")), F.lower(stripped("heading"))
    unlike = F.when((section != "") & ((heading == section) | F.contains(heading, section)), 0).otherwise(1)
    best = once.join(chunks.select("doc_id", "chunk_id", "chunk_index", "heading"), "doc_id").groupBy("query_id", "doc_id", "l").agg(
        F.min_by("chunk_id", F.struct(unlike, "chunk_index")).alias("chunk_id")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("l.rank", "l.pos"))
    return (
        best.withColumn("place", place)
        .filter(F.col("place") <= limit)
        .select("query_id", "place", "chunk_id", "doc_id", (F.col("l.score") * factor).alias("score"), (F.col("l.fusion") * factor).alias("fusion"))
    )


def graph_neighbours(selected: DataFrame, graph: DataFrame, limit: int = DEFAULTS.max_linked, factor: float = DEFAULTS.linked_factor) -> DataFrame:
    """The first candidates one hop away whose document is not selected: query_id, place, chunk_id, doc_id, score."""
    near = graph.filter("hop = 1").join(selected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return (
        near.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "place", "chunk_id", "doc_id", (F.col("similarity") * factor).alias("score"))
    )
