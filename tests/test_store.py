import glob
import os

import pytest
from pyspark.sql import functions as F

from notegrid.operators import fulltext as ft
from notegrid.operators import graph as g
from notegrid.operators import index as ix
from notegrid.operators import scoring
from notegrid.sources import notes as src
from notegrid.sources import store


def files(dest):
    return {os.path.relpath(f, dest) for f in glob.glob(f"{dest}/v-*/**/*.parquet", recursive=True)}


def tables(spark, rows):
    notes = spark.createDataFrame(rows, "path string, sha256 string")
    chunks = notes.select("path", F.explode(F.array(F.concat("sha256", F.lit("a")), F.concat("sha256", F.lit("b")))).alias("content"), F.lit(0).alias("parent_index"))
    return {"notes": notes, "chunks": chunks, "parents": notes.select("path", F.lit(0).alias("parent_index"))}


def contents(index):
    return {name: sorted(map(tuple, df.collect())) for name, df in index.items()}


def test_a_small_change_rewrites_few_files(spark, tmp_path):
    dest = str(tmp_path)
    old = [(f"n{i}.md", f"h{i}") for i in range(500)]
    new = [(p, "other" if i in (3, 77) else h) for i, (p, h) in enumerate(old) if i != 200] + [("z.md", "new"), ("y.md", "new")]
    store.create_index(spark, tables(spark, old), dest)
    before = files(dest)
    assert contents(store.open_index(spark, dest)) == contents(tables(spark, old))
    diff = ix.diff_notes(tables(spark, new)["notes"], store.open_index(spark, dest)["notes"])
    changed = [r.path for r in diff.filter("change <> 'unchanged'").collect()]
    assert len(changed) == 5
    fresh = {n: df.filter(F.col("path").isin(changed)) for n, df in tables(spark, new).items()}  # only what changed is at hand
    checks = store.upsert_index(spark, fresh, diff, dest)
    assert contents(store.open_index(spark, dest)) == contents(tables(spark, new)) and checks.filter("NOT ok").isEmpty()
    written = files(dest) - before
    assert 0 < len(written) <= 0.05 * len(before)


def test_failures_leave_the_version_before(spark, tmp_path, monkeypatch):
    dest = str(tmp_path)
    store.create_index(spark, tables(spark, [("a", "1"), ("b", "2")]), dest, 4)
    want = contents(store.open_index(spark, dest))
    lost = spark.createDataFrame([("c", "x", 9)], "path string, content string, parent_index int")
    change = spark.createDataFrame([("c", "new")], "path string, change string")
    with pytest.raises(ValueError, match="not valid"):
        store.upsert_index(spark, {"chunks": lost}, change, dest, 4)
    assert contents(store.open_index(spark, dest)) == want
    calls = []
    whole = store.validate_index
    monkeypatch.setattr(store, "validate_index", lambda t, e: whole(t, e if not calls.append(1) and len(calls) == 1 else {"notes": -1}))
    with pytest.raises(ValueError, match="had become current"):
        store.create_index(spark, tables(spark, [("d", "4")]), dest, 4)
    monkeypatch.undo()
    assert contents(store.open_index(spark, dest)) == want
    gone = spark.createDataFrame([("a", "deleted"), ("b", "deleted")], "path string, change string")
    store.upsert_index(spark, {}, gone, dest, 4)
    assert contents(store.open_index(spark, dest)) == {"notes": [], "chunks": [], "parents": []}


def test_full_text_is_a_part_of_the_version(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a", "el gato"), (2, "b", "el perro")], "chunk_id long, path string, content string")
    store.create_index(spark, {"chunks": chunks, **ft.build(chunks).tables()}, str(tmp_path), 4)
    now = store.open_index(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "perro")], "query_id long, term string")
    assert [r.chunk_id for r in ft.search(asked, ft.FullText.of(now)).collect()] == [2]
    more = spark.createDataFrame([(3, "c", "perro")], "chunk_id long, path string, content string")
    change = spark.createDataFrame([("c", "new")], "path string, change string")
    with pytest.raises(ValueError):  # the full text stays behind
        store.upsert_index(spark, {"chunks": more}, change, str(tmp_path), 4)
    store.upsert_index(spark, {"chunks": more, **ft.build(chunks.unionByName(more)).tables()}, change, str(tmp_path), 4)
    assert [r.chunk_id for r in ft.search(asked, ft.FullText.of(store.open_index(spark, str(tmp_path)))).orderBy("rank").collect()] == [3, 2]


def test_reader_lists_all_names(spark, tmp_path):
    names = ["_b.md", "c/_d/e.md", "c/f.MD", "c/.oculto.md", "_plantillas/x.md", "c/_TEMPLATES/y.md", ".obsidian/z.md", "c/.git/w.md", "c/no.txt", "h i/j=k/ñ.md", "_a/_b/_c/_d/_e/f.md"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    want = {"_b.md", "c/_d/e.md", "c/f.MD", "h i/j=k/ñ.md", "_a/_b/_c/_d/_e/f.md"}
    root = f"file:{tmp_path}"
    first = src.read_notes(spark, root)
    assert {r.path: r.raw for r in first.collect()} == {n: n for n in want} and first.select("path").distinct().count() == len(want)
    assert {r.path for r in src.list_notes(spark, str(tmp_path)).collect()} == want
    assert {r.path for r in src.read_notes(spark, root, paths=["_b.md", "nada.md"]).collect()} == {"_b.md"}
    known = spark.createDataFrame(first.select("path", "mtime").collect(), "path string, mtime timestamp")
    os.utime(tmp_path / "c/f.MD", (1_700_000_000, 1_700_000_000))
    (tmp_path / "c/new.md").write_text("x")
    assert {r.path for r in src.read_notes(spark, root, known=known).collect()} == {"c/f.MD", "c/new.md"}


def test_added_aliases_resolve_broken_links(spark):
    links = [(i, 0, f"Nota {i % 40}.md" if i % 3 else "area/nota 7") for i in range(200)]
    old = spark.createDataFrame([(f"nota {i}", i) for i in range(0, 40, 2)], "alias string, doc_id long")
    added = spark.createDataFrame([(f"nota {i}", i) for i in (1, 7, 9)], "alias string, doc_id long")
    edges = g.resolve_links(spark.createDataFrame(links, "source long, pos int, target string"), old)
    got = sorted(map(tuple, g.reresolve(edges, old, added).select("source", "pos", "target_id").collect()))
    assert got == sorted(map(tuple, g.reresolve(edges, old.union(added)).select("source", "pos", "target_id").collect()))
    assert sum(t is not None for *_, t in got) > edges.filter("target_id IS NOT NULL").count()
    assert g.reresolve(edges, old, added.limit(0)).count() == edges.count()


def test_scorers_by_name(spark):
    rows = spark.createDataFrame([(1, 10, "el gato", "Un gato"), (1, 11, "el gato", None), (2, 10, None, "x")], "query_id long, chunk_id long, question string, passage string")
    got = {(r.query_id, r.chunk_id): r.rerank for r in scoring.scored(rows, "overlap").collect()}
    assert got == {(1, 10): 0.5, (1, 11): 0.0, (2, 10): 0.0}
    scoring.scorer("half")(lambda: lambda questions, passages: [0.5] * len(passages))
    assert {r.rerank for r in scoring.scored(rows, "half").collect()} == {0.5}
    with pytest.raises(ValueError, match="unknown scorer"):
        scoring.scored(rows, "nada")
