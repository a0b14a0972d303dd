"""A stored full-text index and a pruned BM25 search for many questions at once.

The chunks are parted in spans of a few thousand. For each term and span there is one block with the
chunks that hold it, so a frequent term is many blocks, and a block is bounded. A block carries the largest frequency
and the smallest length in it, from which follows the most that it can add to a score, whatever
the averages are at the time of a search. Blocks are dealt to buckets by a hash of the term and sorted by term, so
that a batch of questions reads the row groups of its terms. Searching reads no text.

A search sums, for each question and span, what the blocks can add at most (headers only). The best spans give each
question its k best so far; then only spans whose bound reaches the k-th are scored. A task streams
over spans: first the blocks, then the questions, and hands back at most k rows for each question.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded
from ..params import DEFAULTS
from ..shared import kept
from .retrieval import FIELDS, WORD

#: Chunks of a span on average. Spans of neighbouring ids may hold UNEVEN times as many, else ids are hashed.
SPAN, UNEVEN = 2048, 4
#: Buckets of terms, and spans that share a file of a bucket.
BUCKETS, SPANS_A_FILE = 32, 4096
#: Bytes of a row group, so that a term is found without reading much else.
ROW_GROUP = 4 << 20
#: Words of chunks that a task gathers at once, and different words that it remembers.
HELD, KNOWN = 2_000_000, 500_000
#: Spans of a question that are scored first, and what rounding may take from a bound.
SEEDS, SLACK = 2, 1e-8
#: Distinct terms up to which a filter names them, so that it reaches the files.
NAMED_TERMS = 2_000


@dataclass(frozen=True)
class FullText:
    """blocks: bucket, term, span, chunk_ids, tfs, lengths, n, max_tf, min_length. terms: bucket, term, df.
    members: span, chunk_id, length. stats (one row): n, total, base, width, spans."""

    blocks: DataFrame
    terms: DataFrame
    members: DataFrame
    stats: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f"fulltext_{name}": getattr(self, name) for name in ("blocks", "terms", "members", "stats")}

    @staticmethod
    def of(tables: Mapping[str, DataFrame]) -> FullText:
        return FullText(*(tables[f"fulltext_{name}"] for name in ("blocks", "terms", "members", "stats")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _span(chunk_id: str, base: int, width: int, spans: int) -> Column:
    if spans:
        return F.pmod(F.xxhash64(chunk_id), F.lit(spans))
    return F.expr(f"({chunk_id} - ({base}L)) div {width}L")


def _spans_of(chunks: DataFrame) -> tuple[int, int, int, int]:
    """(n, base, width, spans): neighbouring ids share a span if that parts the chunks evenly enough, else a hash does."""
    n, low, high = chunks.agg(F.count("chunk_id"), F.min("chunk_id"), F.max("chunk_id")).first()
    if not n:
        return 0, 0, 1, 0
    width = max(1, (high - low + 1) * SPAN // n)
    largest = chunks.groupBy(_span("chunk_id", low, width, 0).alias("span")).count().agg(F.max("count")).first()[0]
    return (n, low, width, 0) if largest <= UNEVEN * SPAN else (n, 0, 1, -(-n // SPAN))


class Terms(dict):
    """Numbers for the terms of a task's texts, by stretches without white space. A stretch with no or several terms has a negative number."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        self.several: list[list[int]] = []

    def number(self, term: str) -> int:
        if term not in self.numbers:
            self.numbers[term] = len(self.names)
            self.names.append(term)
        return self.numbers[term]

    def __missing__(self, stretch: str) -> int:
        terms = [t for word in WORD(stretch.casefold()) for t in WORD(folded(word))]
        if len(terms) == 1:
            got = self.number(terms[0])
        else:
            self.several.append([self.number(t) for t in terms])
            got = -len(self.several)
        self[stretch] = got
        return got

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if (got < 0).any():
            got = np.array([n for x in got.tolist() for n in ([x] if x >= 0 else self.several[-x - 1])], np.int64)
        return got

    def shorten(self) -> None:
        if len(self) > KNOWN:
            self.__init__()
            self.clear()


def _posted(ids: np.ndarray, spans: np.ndarray, codes: list, where: list, gains: list, names: list[str]) -> pa.RecordBatch:
    """Postings of some chunks by span and term, and a row without a term for each span: its chunks and their lengths."""
    none = np.zeros(0, np.int64)
    code, row, gain = (np.concatenate(x or [none]) for x in (codes, where, gains))
    lengths = np.bincount(row, minlength=len(ids))
    pair, of = np.unique(code * len(ids) + row, return_inverse=True)
    tf = np.bincount(of, gain, len(pair))
    code, row = pair // len(ids), pair % len(ids)
    # every chunk once more, without a term
    code, row, tf = np.append(code, np.full(len(ids), -1)), np.append(row, np.arange(len(ids))), np.append(tf, np.zeros(len(ids)))
    order = np.lexsort((row, code, spans[row]))
    code, row, tf = code[order], row[order], tf[order]
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (spans[row][1:] != spans[row][:-1])) + 1
    first, ends = np.concatenate([[0], cuts]), np.concatenate([[0], cuts, [len(code)]]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[row], tf, lengths[row].astype(np.int32))]
    terms = pa.array([names[c] if c >= 0 else None for c in code[first].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(spans[row][first]), terms, *lists], names=["span", "term", "chunk_ids", "tfs", "lengths"])


def build(chunks: DataFrame, fields: dict[str, float] = FIELDS) -> FullText:
    """The index of chunks (chunk_id, unique, and those of the fields that it has): one pass over the texts.

    A posting weighs the occurrences of a term by field; the length of a chunk is its number of tokens. Chunks
    without a token count among the chunks. Postings are gathered by term and span in the task that reads
    the texts, and once more in the shuffle.
    """
    spark = chunks.sparkSession
    present = [f for f in fields if f in chunks.columns]
    read = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *present)
    n, base, width, spans = _spans_of(read.select("chunk_id"))
    weights = [fields[f] for f in present]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            ids, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [c.to_pylist() for c in batch.columns[2:]]
            at, held, codes, where, gains = 0, 0, [], [], []
            for row in range(batch.num_rows):
                for weight, column in zip(weights, texts):
                    if column[row]:
                        found = terms.of(column[row])
                        codes.append(found)
                        where.append(np.full(len(found), row - at))
                        gains.append(np.full(len(found), weight))
                        held += len(found)
                if held > HELD or row + 1 == batch.num_rows:
                    part = slice(at, row + 1)
                    yield _posted(ids[part], spans[part], codes, where, gains, terms.names)
                    at, held, codes, where, gains = row + 1, 0, [], [], []
            terms.shorten()

    cores = spark.sparkContext.defaultParallelism
    if read.rdd.getNumPartitions() < cores:  # a few large row groups: texts are dealt to all cores
        read = read.repartition(cores)
    located = read.filter("chunk_id IS NOT NULL").select("chunk_id", _span("chunk_id", base, width, spans).alias("span"), *present)
    raw = kept(located.mapInArrow(run, "span long, term string, chunk_ids array<long>, tfs array<double>, lengths array<int>"), "postings")
    parts = F.collect_list(F.struct("chunk_ids", "tfs", "lengths"))
    whole = raw.filter("term IS NOT NULL").groupBy("term", "span").agg(parts.alias("p"))
    blocks = whole.select(
        "term", "span", *(F.flatten(f"p.{c}").alias(c) for c in ("chunk_ids", "tfs", "lengths"))
    ).select(
        "term", "span", "chunk_ids", "tfs", "lengths", F.size("chunk_ids").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_length"),
        _bucket(F.col("term")).alias("bucket"),
    )
    dfs = raw.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("chunk_ids")).alias("df")).withColumn("bucket", _bucket(F.col("term")))
    members = raw.filter("term IS NULL").select("span", F.inline(F.arrays_zip("chunk_ids", "lengths"))).withColumnsRenamed({"chunk_ids": "chunk_id", "lengths": "length"})
    total = members.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
    stats = total.select(F.lit(n).cast("long").alias("n"), "total", *(F.lit(x).cast("long").alias(name) for x, name in ((base, "base"), (width, "width"), (spans, "spans"))))
    return FullText(blocks, dfs, members, stats)


def write(index: FullText, dest: str) -> None:
    """The four tables below dest: blocks and terms by bucket, sorted by term."""
    dealt = index.blocks.repartition("bucket", F.expr(f"span div {SPANS_A_FILE}")).sortWithinPartitions("bucket", "term", "span")
    dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").mode("overwrite").parquet(f"{dest}/fulltext_blocks")
    index.terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{dest}/fulltext_terms")
    index.members.write.mode("overwrite").parquet(f"{dest}/fulltext_members")
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{dest}/fulltext_stats")


BLOCK_SCHEMA = "term string, span long, chunk_ids array<long>, tfs array<double>, lengths array<int>, n int, max_tf double, min_length int, bucket int"


def load(spark: SparkSession, dest: str) -> FullText:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{dest}/fulltext_{name}")
    return FullText(
        read("blocks", BLOCK_SCHEMA),
        read("terms", "term string, df long, bucket int"),
        read("members", "span long, chunk_id long, length int"),
        read("stats", "n long, total long, base long, width long, spans long"),
    )


def search(
    terms: DataFrame, index: FullText, k: int = 40, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b, passing: DataFrame | None = None
) -> DataFrame:
    """query_id, chunk_id, bm25, rank for the OR of the terms (query_id, term), best first; ties: lowest chunk_id.

    Frequencies and lengths are those of the whole index; with passing (chunk_id), only its chunks are
    ranked. The k best are exact: a span is left out only if the sum of its bounds is below the k-th best score.
    """
    spark = terms.sparkSession
    asked = kept(terms.select(F.col("query_id").cast("long"), "term").distinct().withColumn("bucket", _bucket(F.col("term"))), "asked")
    s = index.stats.first()
    empty = spark.createDataFrame([], "query_id long, chunk_id long, bm25 double, rank int")
    if s is None or not s.n or asked.isEmpty():
        return empty
    mean = max(s.total / s.n, 1e-300)
    wanted = asked.select("bucket", "term").distinct()
    few = [r.term for r in wanted.limit(NAMED_TERMS + 1).collect()]
    if len(few) <= NAMED_TERMS:
        named = lambda df: df.filter(F.col("bucket").isin(sorted({r.bucket for r in wanted.collect()})) & F.col("term").isin(few))
    else:
        named = lambda df: df.join(wanted, ["bucket", "term"], "left_semi")
    idf = F.log(F.lit(1.0) + (F.lit(float(s.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = kept(asked.join(named(index.terms), ["bucket", "term"]).select("query_id", "term", idf.alias("idf")), "weights")
    most = F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_length") / mean))
    headers = named(index.blocks).select("term", "span", most.alias("most"))
    bounds = kept(weighted.join(headers, "term").groupBy("query_id", "span").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        """The k best chunks of each pair of question and span."""
        none = {c: F.lit(None).cast(kind) for c, kind in (("term", "string"), ("chunk_ids", "array<long>"), ("tfs", "array<double>"), ("lengths", "array<int>"), ("query_id", "long"), ("names", "array<string>"), ("idfs", "array<double>"), ("least", "double"))}
        shape = lambda df, kind, *own: df.select("span", F.lit(kind).alias("kind"), *(F.col(c) if c in own else v.alias(c) for c, v in none.items()))
        spans = pairs.select("span").distinct()
        blocks = shape(named(index.blocks).join(spans, "span", "left_semi"), 0, "term", "chunk_ids", "tfs", "lengths")
        own = weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("t"))  # the terms of a question
        questions = shape(pairs.join(own, "query_id").select("span", "query_id", F.col("t.term").alias("names"), F.col("t.idf").alias("idfs"), "least"), 2, "query_id", "names", "idfs", "least")
        rows = blocks.unionByName(questions)
        if passing is not None:
            located = passing.select(F.col("chunk_id").cast("long").alias("chunk_id")).withColumn("span", _span("chunk_id", s.base, s.width, s.spans))
            by_span = located.join(spans, "span", "left_semi").groupBy("span").agg(F.collect_set("chunk_id").alias("chunk_ids"))
            rows = rows.unionByName(shape(by_span, 1, "chunk_ids"))
        dealt = rows.repartition("span").sortWithinPartitions("span", "kind")
        only = passing is not None
        return dealt.mapInArrow(lambda batches: _best_of_spans(batches, k, k1, b, mean, only), "query_id long, chunk_id long, bm25 double")

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
    ordered = bounds.withColumn("place", F.row_number().over(by_bound))
    ranking = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
    first = kept(ranked(scored(ordered.filter(F.col("place") <= SEEDS).select("query_id", "span", F.lit(0.0).alias("least")))), "first spans")
    reached = first.filter(F.col("rank") == k).select("query_id", (F.col("bm25") - SLACK).alias("least"))
    rest = kept(
        ordered.filter(F.col("place") > SEEDS).join(reached, "query_id", "left").select("query_id", "span", "bound", F.coalesce("least", F.lit(0.0)).alias("least"))
        .filter(F.col("bound") >= F.col("least")).drop("bound"),
        "other spans",
    )
    if rest.isEmpty():
        return first
    return ranked(first.drop("rank").unionByName(scored(rest)))


def _best_of_spans(batches: Iterator[pa.RecordBatch], k: int, k1: float, b: float, mean: float, only: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by span and kind: blocks, chunks that pass (if only), questions."""
    span, ids, posts, passes = None, None, {}, None
    parts: list[tuple[str, np.ndarray, np.ndarray]] = []

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets from 0, and the values of a stretch of a list column."""
        at = column.offsets.to_numpy()
        return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]

    for batch in batches:
        spans, kinds = batch.column("span").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((spans[1:] != spans[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(spans)], strict=True):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if spans[lo] != span:
                span, ids, posts, passes, parts = spans[lo], None, {}, None, []
            if kinds[lo] == 0:
                (at, chunk), (_, tf), (_, length) = (lists(part.column(c)) for c in ("chunk_ids", "tfs", "lengths"))
                weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                parts += [(t, chunk[x:y], weight[x:y]) for t, x, y in zip(part.column("term").to_pylist(), at, at[1:])]
            elif kinds[lo] == 1:
                at, chunk = lists(part.column("chunk_ids"))
                passes = chunk
            elif parts or posts:
                if parts:
                    ids = np.unique(np.concatenate([p[1] for p in parts]))
                    allowed = np.isin(ids, passes if passes is not None else []) if only else None
                    posts, parts = {t: (np.searchsorted(ids, chunk), w) for t, chunk, w in parts}, []
                out = []
                for q, names, idfs, least in zip(*(part.column(c).to_pylist() for c in ("query_id", "names", "idfs", "least"))):
                    met = [(posts[t], idf) for t, idf in zip(names, idfs) if t in posts]
                    if not met:
                        continue
                    place = np.concatenate([p for (p, _), _ in met])
                    score = np.bincount(place, np.concatenate([w * idf for (_, w), idf in met]), len(ids))
                    hit = np.bincount(place, minlength=len(ids)) > 0
                    score = np.round(score, 12)
                    hit &= score >= least
                    if only:
                        hit &= allowed
                    found = np.flatnonzero(hit)
                    found = found[np.lexsort((ids[found], -np.round(score[found], 9)))[:k]]
                    out.append((np.full(len(found), q), ids[found], score[found]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "chunk_id", "bm25"])
