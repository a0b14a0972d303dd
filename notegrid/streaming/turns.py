"""Count windows over a stream of conversation turns, from high-water marks on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import DEFAULTS

OUT = "conversation_id long, batch int, first_turn long, last_turn long, n int"
#: Typed state with initial values needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnBatches(StatefulProcessor):
    """State of a conversation: its mark, whether its memory is on, the batches so far, and the turns that wait."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "mark long, enabled boolean, done int")
        self.waiting = handle.getListState("waiting", "turn_id long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.status.update((int(row["mark"]), bool(row["enabled"]), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, enabled, done = self.status.get() if self.status.exists() else (-1, True, 0)
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        known, out = set(held), []
        new = pd.concat(list(rows)).sort_values("turn_id", kind="stable")
        for turn, evidence, use in zip(new["turn_id"].tolist(), new["evidence"].tolist(), new["use_memory"].tolist()):
            if pd.notna(use):
                enabled = bool(use)
            if turn > mark and turn not in known:
                held.append(turn)
                known.add(turn)
            if not (enabled and evidence) or len(held) < self.size:
                continue
            held.sort()
            while len(held) >= self.size:
                batch, held = held[: self.size], held[self.size :]
                out.append((key[0], done, batch[0], batch[-1], self.size))
                mark, done = batch[-1], done + 1
            known = set(held)
        self.status.update((mark, enabled, done))
        if held:
            self.waiting.put([(t,) for t in held])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["conversation_id", "batch", "first_turn", "last_turn", "n"])

    def close(self) -> None:
        pass


def turn_batches_stream(turns: DataFrame, size: int = DEFAULTS.memory_interval, memory: DataFrame | None = None) -> DataFrame:
    """Batches of exactly `size` turns of a conversation after its mark: never overlapping, partial ones wait.

    turns is a stream of conversation_id, turn_id and, if it has them, evidence and use_memory. memory
    (conversation_id, summarized_until_turn_id, memory_enabled) is the state to start from, as in `pending_batches`; a
    conversation without a row starts at the beginning with its memory on. A turn turns the memory on or off
    by its use_memory (null: as before). All turns count, but only one with evidence while memory is on releases what is full.
    Turns that repeat, or that are not beyond the mark, are dropped; a late turn beyond it takes its place by id.
    Numbers of batches start from 0. The state of a key is its mark and the turns that wait.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    optional = lambda c: (F.col(c) if c in turns.columns else F.lit(None)).cast("boolean")
    rows = turns.select(
        F.col("conversation_id").cast("long").alias("conversation_id"), F.col("turn_id").cast("long").alias("turn_id"),
        F.coalesce(optional("evidence"), F.lit("evidence" not in turns.columns)).alias("evidence"), optional("use_memory").alias("use_memory"),
    ).filter("turn_id IS NOT NULL")
    start = None
    if memory is not None:
        start = memory.select(
            F.col("conversation_id").cast("long").alias("conversation_id"),
            F.coalesce(F.col("summarized_until_turn_id").cast("long"), F.lit(-1).cast("long")).alias("mark"),
            F.coalesce("memory_enabled", F.lit(True)).alias("enabled"),
        ).groupBy("conversation_id")
    return rows.groupBy("conversation_id").transformWithStateInPandas(TurnBatches(size), OUT, "append", "none", start)


def run_turn_batches(turns: DataFrame, sink: str, checkpoint: str, size: int = DEFAULTS.memory_interval, memory: DataFrame | None = None) -> None:
    """Drains what the stream has now into Parquet files."""
    query = (
        turn_batches_stream(turns, size, memory).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
