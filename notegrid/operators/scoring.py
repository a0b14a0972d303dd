"""Scorers of passages by name: the point at which a caller brings a model of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import folded
from .retrieval import WORD

#: make() is called once for each task (that is where a model is loaded) and gives a function of questions and passages to scores from 0 to 1.
Scorer = Callable[[list[str], list[str]], list[float]]
SCORERS: dict[str, Callable[[], Scorer]] = {}


def scorer(name: str) -> Callable[[Callable[[], Scorer]], Callable[[], Scorer]]:
    """Registers a maker of scorers under a name."""

    def add(make: Callable[[], Scorer]) -> Callable[[], Scorer]:
        SCORERS[name] = make
        return make

    return add


def words(text: str) -> set[str]:
    return {folded(w) for w in WORD((text or "").casefold())}


@scorer("overlap")
def overlap() -> Scorer:
    """The share of the question's words that the passage holds."""

    def score(questions: list[str], passages: list[str]) -> list[float]:
        known = {q: words(q) for q in set(questions)}
        return [len(known[q] & words(p)) / len(known[q]) if known[q] else 0.0 for q, p in zip(questions, passages)]

    return score


def scored(rows: DataFrame, name: str) -> DataFrame:
    """query_id, chunk_id, rerank of rows (query_id, chunk_id, question, passage), in Arrow batches."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(sorted(SCORERS))}")
    make = SCORERS[name]
    rows = rows.select("query_id", "chunk_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("passage", F.lit("")).alias("passage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            given = [float(s) for s in score(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            if len(given) != batch.num_rows:
                raise ValueError(f"scorer {name} gave {len(given)} scores for {batch.num_rows} passages")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(given, pa.float64())], names=["query_id", "chunk_id", "rerank"])

    return rows.mapInArrow(run, StructType([rows.schema["query_id"], rows.schema["chunk_id"], StructField("rerank", DoubleType())]))
