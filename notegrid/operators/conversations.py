"""Conversations: memory status, batches to summarise, context usage, citation audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import est_tokens, right_stripped, stripped
from ..params import DEFAULTS


def memory_status(keys: DataFrame, turns: DataFrame, memory: DataFrame, key: str = "conversation_id") -> DataFrame:
    """key, total_turns, summarized_turns, pending, has_summary for every key; memory: key, summary, summarized_count."""
    counts = turns.groupBy(key).agg(F.count("*").alias("total_turns"))
    done = F.coalesce("summarized_count", F.lit(0))
    total = F.coalesce("total_turns", F.lit(0))
    return keys.select(key).join(counts, key, "left").join(memory, key, "left").select(
        key, total.alias("total_turns"), done.alias("summarized_turns"), F.greatest(F.lit(0), total - done).alias("pending"),
        (F.coalesce(stripped("summary"), F.lit("")) != "").alias("has_summary"),
    )


def recent_turns(turns: DataFrame, n: int = DEFAULTS.recent_turns, key: str = "conversation_id") -> DataFrame:
    """The last n turns of each key; place counts them in ascending order."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn_id")))
    last = turns.withColumn("__r", newest).filter(F.col("__r") <= n).drop("__r")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("turn_id")))


def pending_batches(turns: DataFrame, memory: DataFrame, size: int = DEFAULTS.memory_interval, key: str = "conversation_id") -> DataFrame:
    """The next `size` turns after the high-water mark of each key, if there are as many and its memory is on.

    memory: key, summarized_until_turn_id, memory_enabled; a key without a row starts at the beginning.
    """
    later = turns.join(memory.select(key, "summarized_until_turn_id", "memory_enabled"), key, "left").filter(
        F.coalesce("memory_enabled", F.lit(True)) & (F.col("turn_id") > F.coalesce("summarized_until_turn_id", F.lit(-1)))
    )
    order = Window.partitionBy(key).orderBy("turn_id")
    numbered = later.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    full = F.count("*").over(Window.partitionBy(key)) == size
    return numbered.withColumn("__full", full).filter("__full").select(key, "turn_id", "place")


def all_batches(turns: DataFrame, size: int = DEFAULTS.memory_interval, key: str = "conversation_id") -> DataFrame:
    """key, batch, first_turn, last_turn, n of all full batches from the beginning."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("turn_id"))
    batch = F.floor((number - 1) / size).cast("int")
    return (
        turns.withColumn("batch", batch).groupBy(key, "batch")
        .agg(F.min("turn_id").alias("first_turn"), F.max("turn_id").alias("last_turn"), F.count("*").alias("n")).filter(F.col("n") == size)
    )


def advance_mark(old: DataFrame, new: DataFrame, key: str = "conversation_id") -> DataFrame:
    """High-water marks after an update; they only move forward."""
    n = new.select(key, F.col("summarized_until_turn_id").alias("__n"))
    return old.join(n, key, "full_outer").select(key, F.greatest("summarized_until_turn_id", "__n").alias("summarized_until_turn_id"))


def _cut(c: Column, limit: Column) -> Column:
    t = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(right_stripped(F.substring(t, F.lit(1), (limit - 1).cast("int"))), F.lit("…")))


def format_memory(recent: DataFrame, memory: DataFrame, budget: int = DEFAULTS.memory_context_chars, key: str = "conversation_id") -> DataFrame:
    """key, text: the summary (a third of the budget, 500 at least) and the recent turns, which share the rest (200 each at least)."""
    joined = recent.join(memory.select(key, "summary"), key, "left")
    for_summary = F.greatest(F.lit(500), F.floor(F.lit(budget) / 3))
    summary = _cut(F.col("summary"), for_summary)
    n = F.count("*").over(Window.partitionBy(key))
    room = F.greatest(F.lit(200), F.floor((F.lit(budget) - F.length(summary)) / (2 * n)))
    line = F.concat(F.lit("Usuario: "), _cut(F.col("question"), room), F.lit("\nAsistente: "), _cut(F.col("answer"), room))
    lines = joined.select(key, "place", summary.alias("s"), line.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    text = F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n")
    return lines.groupBy(key).agg(F.max("s").alias("s"), text.alias("t")).select(
        key, F.concat(F.when(F.col("s") != "", F.concat(F.lit("Resumen: "), F.col("s"), F.lit("\n\n"))).otherwise(""), "t").alias("text")
    )


def role_usage(turns: DataFrame) -> DataFrame:
    """project_id, turn_id, role, ok, usage (percent to two places), tokens from agent_metrics, a JSON object by role.

    Two rows for each turn whose metrics are a JSON object (null or empty: an object without roles); other turns do not count.
    """
    parsed = F.try_parse_json(F.coalesce(F.nullif("agent_metrics", F.lit("")), F.lit("{}")))
    rows = (
        turns.select("project_id", "turn_id", F.try_variant_get(parsed, "$", "map<string,variant>").alias("m"))
        .filter(F.col("m").isNotNull())
        .select("project_id", "turn_id", F.explode(F.array(F.lit("verifier"), F.lit("writer"))).alias("role"), "m")
        .select("project_id", "turn_id", "role", F.col("m")[F.col("role")].alias("x"))
    )
    part = lambda name: F.coalesce(F.floor(F.try_variant_get("x", f"$.{name}", "double")), F.lit(0)).cast("double")
    tokens = F.coalesce(F.nullif(part("total_tokens"), F.lit(0.0)), part("prompt_tokens") + part("completion_tokens"))
    window = part("context_window_tokens")
    ok = F.coalesce(F.try_variant_get("x", "$.status", "string").isin("completed", "degraded") & (window > 0) & (tokens >= 0), F.lit(False))
    usage = F.when(ok, F.bround(F.least(F.lit(100.0), tokens / window * 100), 2))
    return rows.select("project_id", "turn_id", "role", ok.alias("ok"), usage.alias("usage"), F.when(ok, tokens).alias("tokens"))


def context_usage(turns: DataFrame) -> DataFrame:
    """project_id, role, latest, max_usage, avg_usage, samples. latest: of the last turn with valid JSON, null if the role is absent there."""
    rows = role_usage(turns)
    return rows.groupBy("project_id", "role").agg(
        F.max_by("usage", "turn_id").alias("latest"), F.max("usage").alias("max_usage"), F.round(F.avg("usage"), 6).alias("avg_usage"), F.count("usage").alias("samples")
    )


def context_totals(turns: DataFrame) -> DataFrame:
    """project_id, latest, max_usage, avg_usage, samples over both roles: the larger of the latest, the largest, and the mean of all."""
    by_role = role_usage(turns).groupBy("project_id", "role").agg(
        F.max_by("usage", "turn_id").alias("latest"), F.max("usage").alias("most"), F.sum("usage").alias("total"), F.count("usage").alias("n")
    )
    return by_role.groupBy("project_id").agg(
        F.max("latest").alias("latest"), F.max("most").alias("max_usage"), F.round(F.try_divide(F.sum("total"), F.sum("n")), 2).alias("avg_usage"), F.sum("n").alias("samples")
    )


def last_inference(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """key, last_percent: the larger usage of the two roles in the last turn of each key that has any; it is never summed."""
    rows = role_usage(turns.withColumnRenamed(key, "project_id")).filter("ok").groupBy("project_id", "turn_id").agg(F.max("usage").alias("usage"))
    return rows.groupBy(F.col("project_id").alias(key)).agg(F.max_by("usage", "turn_id").alias("last_percent"))


def context_overview(turns: DataFrame, recent: DataFrame, memory: DataFrame, key: str = "conversation_id") -> DataFrame:
    """key, stored_tokens, recent_tokens, summary_tokens: estimates of what a conversation holds and of what is sent."""
    size = est_tokens(F.col("question")) + est_tokens(F.col("answer"))
    stored = turns.groupBy(key).agg(F.sum(size).alias("stored_tokens"))
    sent = recent.groupBy(key).agg(F.sum(size).alias("recent_tokens"))
    return (
        stored.join(sent, key, "left").join(memory.select(key, est_tokens(F.col("summary")).alias("summary_tokens")), key, "left")
        .select(key, "stored_tokens", F.coalesce("recent_tokens", F.lit(0)).alias("recent_tokens"), F.coalesce("summary_tokens", F.lit(0)).alias("summary_tokens"))
    )


# A mark of a source, and what a model thinks aloud.
CITATION = r"\[([0-9]{1,3})\]"
THINK = r"(?is)<think>.*?</think>"


def audit_citations(turns: DataFrame) -> DataFrame:
    """turns with total, valid, invalid (sorted distinct), unused_sources and their number unused, uncited, clean (invalid marks become [?], think blocks go) and sufficiency.

    turns: answer, n_sources, abstained, report. An abstained turn has no sources, and a blank answer has nothing to report.
    """
    answer = F.regexp_replace(F.coalesce("answer", F.lit("")), THINK, "")
    marks = F.when(stripped(answer) != "", F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))).otherwise(F.array().cast("array<string>"))
    n = F.when(F.col("abstained") | (stripped(answer) == ""), 0).otherwise(F.coalesce("n_sources", F.lit(0)))
    out = turns.withColumn("answer_text", answer).withColumn("marks", marks).withColumn("n", n)
    number = lambda mark: F.regexp_extract(mark, CITATION, 1).cast("int")
    good = lambda x: (x >= 1) & (x <= F.col("n"))
    sources = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("cited", F.transform("marks", number))
    wrong = F.array_distinct(F.filter("marks", lambda m: ~good(number(m))))
    clean = F.aggregate(wrong, F.col("answer_text"), lambda t, mark: F.replace(t, mark, F.lit("[?]")))
    first = F.get(F.filter(F.split(F.coalesce("report", F.lit("")), "\n"), lambda x: stripped(x) != ""), F.lit(0))
    label = F.regexp_extract(F.lower(stripped(first)), r"^suficiencia\s*:\s*(suficiente|parcial|insuficiente)$", 1)
    return (
        out.withColumn("total", F.size("cited"))
        .withColumn("valid", F.size(F.filter("cited", good)))
        .withColumn("invalid", F.array_sort(F.array_distinct(F.filter("cited", lambda x: ~good(x)))))
        .withColumn("unused_sources", F.array_except(sources, "cited"))
        .withColumn("unused", F.size("unused_sources"))
        .withColumn("uncited", (F.col("n") > 0) & (F.col("valid") == 0))
        .withColumn("clean", clean)
        .withColumn("sufficiency", F.nullif(F.coalesce(label, F.lit("")), F.lit("")))
        .drop("answer_text", "cited", "marks", "n")
    )
