"""Routing questions, abstaining, assembling contexts, and the whole retrieval as one batch."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import fold_letters, lexical_terms, right_stripped, stripped
from ..params import DEFAULTS, RELATIONAL_PATTERNS, STRUCTURAL_NOUNS, Params
from ..shared import kept
from . import graph as g
from . import retrieval as r
from .fulltext import FullText, search
from .scoring import scored

#: Names that are sent to all tasks, and that a shard holds if there are more.
SENT_ALIASES = 40_000


def _holds(text: Column, words: tuple[str, ...]) -> list[Column]:
    return [F.contains(text, F.lit(w)).cast("int") for w in words]


def mentioned_notes(queries: DataFrame, aliases: DataFrame, minimum: int = 4, most: int = 3) -> DataFrame:
    """query_id, mentions: how many distinct notes a question names (folded alias of `minimum` characters), `most` at the most.

    Names are looked for by an automaton (Aho-Corasick), in one pass over a question whatever their number.
    They are counted first. A bounded number goes to all tasks; more are dealt to shards by a hash of the name, each
    with an automaton of its own that all questions pass. A name stands for `most` of its notes: more cannot count.
    """
    named = aliases.select(fold_letters(F.col("alias")).alias("name"), F.col("doc_id").cast("long").alias("doc_id")).filter(F.length("name") >= minimum).distinct()
    by_name = Window.partitionBy("name").orderBy("doc_id")
    few = named.withColumn("__r", F.row_number().over(by_name)).filter(F.col("__r") <= most).groupBy("name").agg(F.collect_list("doc_id").alias("docs"))
    names = kept(few, "names")
    asked = queries.select("query_id", fold_letters(F.col("question")).alias("q"))
    n = names.count()
    if n <= SENT_ALIASES:
        sent = queries.sparkSession.sparkContext.broadcast([(r.name, r.docs) for r in names.toLocalIterator()])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            for batch in batches:
                mentions = [len(_noted(automaton, q, most)) for q in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mentions, pa.int32())], names=["query_id", "mentions"])

        return asked.mapInArrow(count, StructType([asked.schema["query_id"], StructField("mentions", IntegerType())]))
    shards = -(-n // max(1, SENT_ALIASES))
    slices = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // shards))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    none = F.lit(None).cast("array<long>")
    rows = names.withColumn("s", each(slices)).select(
        (own("name", shards) * slices + F.col("s")).alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.col("name").alias("text"), "docs"
    ).unionByName(
        asked.withColumn("s", each(shards)).select((F.col("s") * slices + own("query_id", slices)).alias("cell"), F.lit(1).alias("kind"), "query_id", F.col("q").alias("text"), none.alias("docs"))
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, automaton = None, [], None
        for batch in batches:
            ids, found = [], []
            for at, (own_cell, kind, text, docs) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)))):
                if own_cell != cell:
                    cell, held, automaton = own_cell, [], None
                if kind == 0:
                    held.append((text, docs))
                    continue
                if automaton is None:
                    automaton, held = _automaton(held), []
                if got := _noted(automaton, text, most):
                    ids.append(at)
                    found.append(sorted(got))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(ids, pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "docs"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "kind")
    hits = dealt.mapInArrow(look, StructType([asked.schema["query_id"], StructField("docs", ArrayType(LongType()))]))
    counts = hits.groupBy("query_id").agg(F.least(F.size(F.array_distinct(F.flatten(F.collect_list("docs")))), F.lit(most)).alias("m"))  # `most` of each shard
    return asked.join(counts, "query_id", "left").select("query_id", F.coalesce("m", F.lit(0)).alias("mentions"))


def _automaton(names: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for name, docs in names:
        out.add_word(name, docs)
    out.make_automaton()
    return out


def _noted(automaton: ahocorasick.Automaton, question: str | None, most: int) -> set[int]:
    """At most `most` notes whose names the question holds."""
    found: set[int] = set()
    if question and len(automaton):
        for _, docs in automaton.iter(question):
            found.update(docs)
            if len(found) >= most:
                return set(sorted(found)[:most])
    return found


def route(queries: DataFrame, semantic: DataFrame, aliases: DataFrame, edges: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """query_id, relational, mentions, connected, structural, signals, route, confidence, graph_weight, graph_hops.

    queries: query_id, question; semantic: query_id, doc_id, score, rank; edges: source, target.
    """
    q = fold_letters(F.col("question"))
    words = queries.select(
        "query_id",
        (sum(_holds(q, RELATIONAL_PATTERNS), F.lit(0)) > 0).alias("relational"),
        (sum(_holds(q, STRUCTURAL_NOUNS), F.lit(0)) >= 2).alias("structural"),
    )
    seeds = semantic.filter(F.col("rank") <= p.graph_seeds).select("query_id", "doc_id").distinct()
    linked = (
        seeds.join(edges, seeds["doc_id"] == edges["source"])
        .select("query_id", F.col("target").alias("doc_id"), "source")
        .filter(F.col("doc_id") != F.col("source"))
        .join(seeds, ["query_id", "doc_id"], "left_semi")
        .select("query_id", F.lit(True).alias("connected"))
        .distinct()
    )
    top = semantic.groupBy("query_id").agg(F.max("score").alias("best"))
    signals = F.col("relational").cast("int") + (F.col("mentions") >= p.router_min_mentions).cast("int") + F.col("connected").cast("int") + F.col("structural").cast("int")
    weak = F.coalesce(F.col("best"), F.lit(0.0)) < p.min_similarity + p.router_weak_margin
    return (
        words.join(mentioned_notes(queries, aliases), "query_id")
        .join(linked, "query_id", "left")
        .join(top, "query_id", "left")
        .withColumn("connected", F.coalesce("connected", F.lit(False)))
        .withColumn("signals", signals)
        .withColumn("route", F.when(F.col("signals") >= 2, "relational").when(F.col("signals") == 1, "hybrid").when(weak, "unknown").otherwise("factual"))
        .withColumn("confidence", F.col("signals") / 4)
        .transform(lambda df: route_weights(df, p))
        .drop("best")
    )


def route_weights(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """graph_weight and graph_hops by route; also for a route that is known beforehand."""
    weight = F.when(F.col("route") == "relational", p.router_relational_weight).when(F.col("route") == "hybrid", p.router_hybrid_weight).otherwise(0.0)
    return df.withColumn("graph_weight", weight).withColumn("graph_hops", F.when(F.col("graph_weight") > 0, 1).otherwise(0))


# Weights of the six signals of abstention.
SIGNAL_WEIGHTS = {"cosine": 0.30, "margin": 0.15, "coverage": 0.15, "agreement": 0.15, "rerank": 0.15, "fill": 0.10}


def abstention(queries: DataFrame, selected: DataFrame, top_k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.posterior_threshold, enabled: bool = True) -> DataFrame:
    """query_id, the six signals, confidence and abstain for every question, also for those without hits.

    selected: query_id, place, cosine, fusion, coverage, graph_score, rerank. cosine is the first in
    order that is there, not the largest.
    """
    branches = sum((F.col(c).isNotNull().cast("int") for c in ("cosine", "coverage", "graph_score")), F.lit(0))
    per = selected.withColumn("branches", branches).groupBy("query_id").agg(
        F.min_by("cosine", F.when(F.col("cosine").isNotNull(), F.col("place"))).alias("cosine"),
        (F.max(F.when(F.col("place") == 1, F.col("fusion"))) - F.max(F.when(F.col("place") == 2, F.col("fusion")))).alias("margin"),
        F.max("coverage").alias("coverage"),
        F.avg((F.col("branches") >= 2).cast("int")).alias("agreement"),
        F.avg("rerank").alias("rerank"),
        F.least(F.lit(1.0), F.count("*") / top_k).alias("fill"),
    )
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    held = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True)) if enabled else F.lit(False)
    return queries.select("query_id").join(per, "query_id", "left").withColumn("confidence", F.try_divide(total, held)).withColumn("abstain", low)


def cut_content(content: Column, focus: Column, limit: Column) -> Column:
    """content if it fits, else a stretch of it around focus (a third of the room before it), with … at cut ends."""
    text, mark = stripped(F.coalesce(content, F.lit(""))), stripped(F.coalesce(focus, F.lit("")))
    at = F.when(mark == "", -1).otherwise(F.position(mark, text) - 1)
    room = limit - 2
    lead = F.floor((room - F.least(F.length(mark), room)) / 3)
    rough = F.greatest(F.lit(0), at - lead)
    end = F.least(F.length(text), rough + room)
    start = F.greatest(F.lit(0), end - room)
    around = F.concat(
        F.when(start > 0, "…").otherwise(""),
        stripped(F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))),
        F.when(end < F.length(text), "…").otherwise(""),
    )
    head = F.concat(right_stripped(F.substring(text, F.lit(1), (limit - 1).cast("int"))), F.lit("…"))
    return F.when(F.length(text) <= limit, text).when(at < 0, head).otherwise(around)


def build_context(hits: DataFrame, budget: int) -> DataFrame:
    """query_id, context: the hits of a query as numbered blocks, each with an equal share of the budget (240 at least).

    hits: query_id, place, title, path, heading, reason, metadata, content, matched_content.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    per_hit = F.greatest(F.lit(240), F.floor(F.lit(budget) / n)).cast("int")
    shown = F.filter(F.map_entries("metadata"), lambda e: ~F.startswith(e["key"], F.lit("_")))
    meta = F.array_join(F.transform(F.array_sort(shown), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    block = F.concat(
        F.lit("["), F.col("place").cast("string"), F.lit("] Documento: "), F.col("title"), F.lit("\nRuta: "), F.col("path"), F.lit("\nSección: "), F.col("heading"),
        F.lit("\nRecuperación: "), F.col("reason"), F.lit("\nMetadatos: "), F.when(F.coalesce(meta, F.lit("")) == "", "sin metadatos").otherwise(meta),
        F.lit("\nContenido:\n"), F.col("cut"),
    )
    cut = hits.withColumn("cut", cut_content(F.col("content"), F.col("matched_content"), per_hit))
    listed = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return cut.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda s: s["block"]), "\n\n---\n\n").alias("context"))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    links: DataFrame,
    p: Params = DEFAULTS,
    expand: bool = True,
    scorer: str | None = None,
    fulltext: FullText | None = None,
    parents: DataFrame | None = None,
    **filters,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, routes, abstained) for a batch of questions.

    queries: query_id, question, embedding, context_embedding (may be null) and, if it is there, context_question (may be null).
    Words are those of the question itself; routing, links and reranking go by the contextual question and vector where there
    is one. scorer names a scorer of passages (`scoring`) that sorts the first candidates again. With fulltext, words are looked up in that
    index and no text is read for them. With parents (doc_id, parent_index, content), selected also has the texts that `build_context` needs, and
    docs must have status and metadata. Questions that abstain return nothing. chunks: chunk_id, doc_id,
    parent_index, chunk_index, heading, content, embedding, with title, path, status, validity, tags of
    the note. docs: doc_id, title, path. links: source, pos, target_id, section. Questions without a
    semantic hit stop there: neither words nor links bring them back.
    """
    pool = r.filtered(chunks, **filters)
    limit = p.candidate_limit
    cur = r.relative_cutoff(r.semantic_topk(queries, pool, limit, p.min_similarity), p.min_relative_score)
    asked = queries.filter(F.col("context_embedding").isNotNull()).select("query_id", F.col("context_embedding").alias("embedding"))
    ctx = r.relative_cutoff(r.semantic_topk(asked, pool, limit, p.min_similarity), p.min_relative_score)
    where = pool.select("chunk_id", "doc_id")
    merged = r.merge_branches(cur, ctx, p.branch_margin, p.weak_branch_weight).filter(F.col("rank") <= limit)
    # tables of at most `limit` rows a question, from which several branches start: written once
    sem_docs = kept(merged.join(where, "chunk_id"), "semantic")
    semantic = sem_docs.drop("doc_id")
    alive = semantic.select("query_id").distinct()
    edges = links.filter(F.col("target_id").isNotNull()).select("source", F.col("target_id").alias("target"))
    own = F.col("question")
    meant = queries.withColumn("question", F.coalesce("context_question", own) if "context_question" in queries.columns else own).select("query_id", "question")

    def by_words() -> DataFrame:
        terms = queries.join(alive, "query_id", "left_semi").select("query_id", lexical_terms(F.col("question")).alias("terms"))
        exploded = terms.select("query_id", F.explode("terms").alias("term"))
        # words weigh as they do in the whole index; of the filters only the status holds before the limit
        status = filters.get("status")
        passing = r.filtered(chunks, status=status) if status and status.strip() else None
        if fulltext is None:
            bm = r.bm25_topk(exploded, chunks, 2 * limit, p.bm25_k1, p.bm25_b, passing=passing)
        else:
            bm = search(exploded, fulltext, 2 * limit, p.bm25_k1, p.bm25_b, passing)
        bm = bm.join(where.select("chunk_id"), "chunk_id", "left_semi")
        texts = pool.select("chunk_id", F.concat_ws(" ", "title", "heading", "content", "path").alias("text"))
        return kept(r.coverage_gate(bm, texts, terms).filter(F.col("rank") <= limit), "lexical")

    # words and links do not need each other, so the texts are searched while questions are routed and links followed
    with ThreadPoolExecutor(1) as beside:
        lexical_job = beside.submit(by_words)
        routes = kept(route(meant.join(alive, "query_id", "left_semi"), sem_docs, g.alias_index(docs), edges, p), "routes")
        on = routes.filter("graph_weight > 0").select("query_id", "graph_weight")
        starts = g.seeds_of(sem_docs.join(on, "query_id", "left_semi"), p.graph_seeds)
        reached = kept(g.propagate(starts, edges, 1, p.graph_decay, p.graph_backlink), "reached")
        vector = F.coalesce("context_embedding", "embedding").cast("array<double>")
        sims = (
            reached.join(pool.select("doc_id", "chunk_id", F.col("embedding").cast("array<double>").alias("v")), "doc_id")
            .join(queries.select("query_id", vector.alias("q")), "query_id")
            .select("query_id", "doc_id", "chunk_id", r.cosine(F.col("q"), F.col("v")).alias("score"))
        )
        graph = kept(g.graph_candidates(sem_docs, edges, sims, p.graph_max_candidates, reached), "graph")
        lexical = lexical_job.result()

    # the weight of the links depends on the route, so questions are fused by class
    classes = []
    for weight in (0.0, p.router_hybrid_weight, p.router_relational_weight):
        mine = routes.filter(F.col("graph_weight") == weight).select("query_id")
        part = lambda df: df.join(mine, "query_id", "left_semi")  # noqa: B023, E731
        classes.append(r.fuse(part(semantic), part(lexical), part(graph), (p.semantic_weight, p.lexical_weight, weight), p.rrf_k))
    fused = kept(classes[0].unionByName(classes[1]).unionByName(classes[2]), "fused")
    rows = fused.join(pool.select("chunk_id", "doc_id", "parent_index", F.col("embedding").cast("array<double>").alias("embedding")), "chunk_id")
    collapsed = r.collapse_parents(rows.select("query_id", "chunk_id", "doc_id", "parent_index", "rank", "fusion", "embedding"))
    ordered = collapsed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    if scorer is None:
        picked = r.diversify(ordered, p.top_k, p.mmr_lambda, p.max_chunks_per_document).withColumn("rerank", F.lit(None).cast("double"))
    else:
        ordered = kept(ordered.drop("embedding"), "ordered")
        head = ordered.filter(F.col("rank") <= p.rerank_candidates).select("query_id", "chunk_id").join(pool.select("chunk_id", "title", "heading", "content"), "chunk_id")
        scores = kept(scored(r.passages(head, p.rerank_passage_chars).join(meant, "query_id"), scorer), "scores")
        blended = kept(r.blend_rerank(ordered, scores, p.rerank_candidates, p.rerank_weight), "blended")
        vectors = pool.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
        used = F.when(F.col("combined").isNotNull(), F.round("rerank", 4)).alias("rerank")  # a question with one candidate is not reranked
        picked = r.diversify(blended.join(vectors, "chunk_id"), p.top_k, p.mmr_lambda, p.max_chunks_per_document)
        picked = picked.join(blended.select("query_id", "chunk_id", used), ["query_id", "chunk_id"])
    chosen = kept(picked.join(fused.drop("rank"), ["query_id", "chunk_id"]).join(where, "chunk_id"), "chosen")
    decided = kept(abstention(queries, chosen, p.top_k, p.posterior_threshold), "decided")
    selected = chosen.join(decided.filter("NOT abstain").select("query_id"), "query_id", "left_semi")
    if expand:
        base = selected.withColumn("rank", F.col("place"))
        more_links = g.expand_links(base, links, pool.select("doc_id", "chunk_id", "chunk_index", "heading"), p.max_linked, p.linked_factor)
        near = g.graph_neighbours(base, graph, p.max_linked, p.linked_factor)
        linked = more_links.join(on, "query_id", "left_anti").select("query_id", "place", "chunk_id", "doc_id", "score", F.lit("linked").alias("origin"))
        hop = near.join(on, "query_id", "left_semi").select("query_id", "place", "chunk_id", "doc_id", "score", F.lit("neighbour").alias("origin"))
        selected = selected.withColumn("origin", F.lit("ranked")).unionByName(linked.unionByName(hop), allowMissingColumns=True)
    else:
        selected = selected.withColumn("origin", F.lit("ranked"))
    if parents is not None:
        selected = r.hydrate(selected.drop("doc_id"), pool.select("chunk_id", "doc_id", "parent_index", "heading", "content"), parents, docs, **filters)
    return selected, routes, decided
