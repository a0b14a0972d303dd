from pyspark.sql import functions as F
import pytest

from notegrid.operators import conversations as cv
from notegrid.operators import index as ix
from notegrid.streaming.turns import run_turn_batches


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    diff = ix.diff_notes(new, old)
    assert {r.path: r.change for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert tuple(ix.diff_counts(diff).first()) == (3, 2, 1, 1)
    assert sorted(map(tuple, ix.apply_diff(old, new, diff).collect())) == [("a", "1"), ("b", "x"), ("d", "4")]
    assert ix.changed_fields(ix.fingerprint({"a": 1, "b": 2}), ix.fingerprint({"b": 3, "c": 4})) == ["a", "b", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, []), (5, [3.0, None]), (6, [0.0, 1.0]), (7, None)], "id long, embedding array<double>")
    assert sorted(r.id for r in ix.validate_vectors(df).collect()) == [1, 6]


@pytest.fixture
def turns(spark):
    data = [(c, c % 2, i * 10 + c, f"pregunta {i}", "respuesta larga " * 30) for c in (1, 2, 3) for i in range(c * 2 + 1)]
    return spark.createDataFrame(data, "conversation_id long, project_id long, turn_id long, question string, answer string")


def test_memory(spark, turns):
    memory = spark.createDataFrame([(1, "resumen", 2, 11, True), (2, " ", 0, None, False)], "conversation_id long, summary string, summarized_count int, summarized_until_turn_id long, memory_enabled boolean")
    got = {r.conversation_id: r for r in cv.memory_status(turns.select("conversation_id").distinct(), turns, memory).collect()}
    assert (got[1].total_turns, got[1].pending, got[1].has_summary) == (3, 1, True) and got[3].pending == 7 and not got[2].has_summary
    assert [(r.conversation_id, r.turn_id) for r in cv.pending_batches(turns, memory, 3).orderBy("conversation_id", "place").collect()] == [(3, 3), (3, 13), (3, 23)]
    text = {r.conversation_id: r.text for r in cv.format_memory(cv.recent_turns(turns, 2), memory, 900).collect()}
    assert text[1].startswith("Resumen: resumen\n\nUsuario: pregunta 1") and "…" in text[1] and text[2].startswith("Usuario")
    marks = cv.advance_mark(memory.select("conversation_id", "summarized_until_turn_id"), spark.createDataFrame([(1, 5), (3, 9)], "conversation_id long, summarized_until_turn_id long"))
    assert {r.conversation_id: r.summarized_until_turn_id for r in marks.collect()} == {1: 11, 2: None, 3: 9}


def test_usage(spark):
    j = '{"writer":{"status":"%s","prompt_tokens":%d,"completion_tokens":%d,"context_window_tokens":1000}}'
    df = spark.createDataFrame([(1, 1, j % ("completed", 100, 50)), (1, 2, j % ("degraded", 5000, 0)), (1, 3, j % ("failed", 10, 10)), (1, 4, "{roto")], "project_id long, turn_id long, agent_metrics string")
    r = {x.role: x for x in cv.context_usage(df).collect()}["writer"]
    assert (r.max_usage, r.avg_usage, r.samples) == (100.0, 57.5, 2)


def test_citations(spark):
    df = spark.createDataFrame([("<think>[3]</think>a [1] b [7] [07] [1]", 2, False, "\n suficiencia: PARCIAL \n"), ("nada", 2, False, "x"), ("[1]", 2, True, None), (None, None, False, "")], "answer string, n_sources int, abstained boolean, report string")
    a, b, c, d = cv.audit_citations(df).collect()
    assert (a.total, a.valid, a.invalid, a.unused, a.uncited, a.clean, a.sufficiency) == (4, 2, [7], 1, False, "a [1] b [?] [?] [1]", "parcial")
    assert b.uncited and b.sufficiency is None and c.invalid == [1] and not c.uncited and d.total == 0


def test_stream_equals_batches(spark, turns, tmp_path):
    turns.select("conversation_id", "turn_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conversation_id long, turn_id long").parquet(str(tmp_path / "in"))
    run_turn_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), 2)
    want = sorted(map(tuple, cv.all_batches(turns, 2).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    # a second run finds nothing new and repeats no batch
    run_turn_batches(spark.readStream.schema("conversation_id long, turn_id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def brute_batches(turns, marks, size):
    """turns: (key, id, evidence, use) in the order of arrival; pending batches taken again and again after each turn that releases them."""
    state, out = {}, []
    for key, turn, evidence, use in turns:
        s = state.setdefault(key, {"mark": marks.get(key, (-1, True))[0], "on": marks.get(key, (-1, True))[1], "ids": set(), "done": 0})
        s["on"] = s["on"] if use is None else use
        s["ids"].add(turn)
        while evidence and s["on"] and len(next_ := sorted(i for i in s["ids"] if i > s["mark"])[:size]) == size:
            out.append((key, s["done"], next_[0], next_[-1], size))
            s["mark"], s["done"] = next_[-1], s["done"] + 1
    return sorted(out)


def test_stream_from_marks_over_several_runs(spark, tmp_path):
    import random

    rng = random.Random(3)
    seen, schema = [], "conversation_id long, turn_id long, evidence boolean, use_memory boolean"
    marks = {1: (4, True), 2: (-1, False), 3: (7, True)}
    memory = spark.createDataFrame([(k, m if m >= 0 else None, on) for k, (m, on) in marks.items()], "conversation_id long, summarized_until_turn_id long, memory_enabled boolean")
    for run in range(3):
        part = [(key, run * 10 + i, rng.random() < 0.4, rng.choice([None, None, None, True, False])) for key in (1, 2, 3, 4) for i in range(10)]
        part += [(1, 2, True, None), (4, run * 10, False, None)]  # not beyond the mark; a repeated turn
        seen += sorted(part, key=lambda r: r[1])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_turn_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), 3, memory)
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
        assert got == brute_batches(seen, marks, 3)
    assert {r[0] for r in got} >= {1, 3, 4} and max(r[1] for r in got) >= 4


def test_usage_of_broken_and_odd_rows(spark):
    ok = '{"writer":{"status":"completed","total_tokens":%d,"context_window_tokens":1000},"verifier":{"status":"completed","prompt_tokens":"300","context_window_tokens":1000.0}}'
    rows = [(1, 1, ok % 100), (1, 2, "roto"), (2, 1, ok % 500), (2, 2, None), (3, 1, ok % 0), (3, 2, "[1]"), (3, 3, '"x"'), (4, 1, "{roto"), (5, 1, '{"writer": 3, "verifier": {"status": "completed"}}')]
    df = spark.createDataFrame(rows, "project_id long, turn_id long, agent_metrics string")
    got = {(r.project_id, r.role): (r.latest, r.max_usage, r.samples) for r in cv.context_usage(df).collect()}
    assert got == {(1, "writer"): (10.0, 10.0, 1), (1, "verifier"): (30.0, 30.0, 1), (2, "writer"): (None, 50.0, 1), (2, "verifier"): (None, 30.0, 1), (3, "writer"): (0.0, 0.0, 1), (3, "verifier"): (30.0, 30.0, 1), (5, "writer"): (None, None, 0), (5, "verifier"): (None, None, 0)}
    totals = {r.project_id: (r.latest, r.max_usage, r.avg_usage, r.samples) for r in cv.context_totals(df).collect()}
    assert totals == {1: (30.0, 30.0, 20.0, 2), 2: (None, 50.0, 40.0, 2), 3: (30.0, 30.0, 15.0, 2), 5: (None, None, None, 0)}
    assert {r.conversation_id: r.last_percent for r in cv.last_inference(df.withColumnRenamed("project_id", "conversation_id")).collect()} == {1: 30.0, 2: 50.0, 3: 30.0}


def test_blank_answers_and_long_marks(spark):
    df = spark.createDataFrame([("\n\t ", 2, False, None), ("<think>[1]</think>\n", 2, False, None), ("a [0012] [012] [2]", 2, False, None)], "answer string, n_sources int, abstained boolean, report string")
    a, b, c = cv.audit_citations(df).collect()
    assert all((x.total, x.valid, x.invalid, x.unused_sources, x.uncited) == (0, 0, [], [], False) for x in (a, b))
    assert (c.clean, c.invalid, c.unused_sources, c.total) == ("a [0012] [?] [2]", [12], [1], 2)


def test_white_space_of_all_kinds(spark):
    from notegrid.functions.text import est_tokens, stripped
    from notegrid.operators.routing import cut_content

    df = spark.createDataFrame([("\n\t ",), (" a ",), ("\n\nabc\x1c",), (None,)], "t string")
    assert [tuple(r) for r in df.select(stripped("t"), est_tokens(F.col("t")), cut_content(F.col("t"), F.lit("\n"), F.lit(100))).collect()] == [("", 0, ""), ("a", 1, "a"), ("abc", 2, "abc"), (None, 0, "")]
