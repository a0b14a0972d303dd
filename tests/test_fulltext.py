import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import fulltext as ft
from notegrid.operators import retrieval as r

FIELDS = {"title": 5.0, "content": 1.0}


def corpus(rng, n, sparse=1):
    words = [f"palabra{i}" for i in range(60)]
    rows = []
    for i in range(n):
        body = [rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.choice([0, 3, 40]))]
        rows.append((i * sparse + 7, rng.choice(["Árbol Ñu", "", None, "palabra1"]), " ".join(["el", *body]) if i % 9 else None))
    return rows


def brute(spark, asked, chunks, k, passing=None):
    scored = r._joined_bm25(asked, chunks, 1.2, 0.75, FIELDS)
    if passing is not None:
        scored = scored.join(passing, "chunk_id", "left_semi")
    top = scored.withColumn("rank", F.row_number().over(r._best(F.desc(F.round("bm25", 9)), "chunk_id"))).filter(F.col("rank") <= k)
    return sorted((x.query_id, x.rank, x.chunk_id, round(x.bm25, 6)) for x in top.collect())


def plain(df):
    return sorted((x.query_id, x.rank, x.chunk_id, round(x.bm25, 6)) for x in df.collect())


@pytest.mark.parametrize(("sparse", "named"), [(1, 2000), (10**6, 0)])
def test_search_equals_all_pairs(spark, tmp_path, monkeypatch, sparse, named):
    monkeypatch.setattr(ft, "SPAN", 20)
    monkeypatch.setattr(ft, "HELD", 50)
    monkeypatch.setattr(ft, "NAMED_TERMS", named)
    rng = random.Random(4)
    rows = corpus(rng, 400, sparse)
    if sparse > 1:
        rows.append((1, "Árbol", "el palabra2"))  # one id far from the others: spans by hash
        rows = [(i if i < 100 else 10**12 + j, t, c) for j, (i, t, c) in enumerate(rows)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, content string").repartition(5)
    ft.write(ft.build(chunks, FIELDS), str(tmp_path))
    index = ft.load(spark, str(tmp_path))
    assert index.members.count() == len(rows) and index.stats.first().n == len(rows)
    assert (index.stats.first().spans > 0) == (sparse > 1)
    asked = [(q, t) for q in range(25) for t in rng.sample(["el", "arbol", "nu", "nadie", *(f"palabra{i}" for i in range(60))], 4)] + [(3, "el"), (30, "nadie")]
    asked = spark.createDataFrame(asked, "query_id long, term string")
    for k in (1, 5, 60):
        assert plain(ft.search(asked, index, k)) == brute(spark, asked.distinct(), chunks, k)
    some = chunks.filter("chunk_id % 3 = 0").select("chunk_id")
    assert plain(ft.search(asked, index, 5, passing=some)) == brute(spark, asked.distinct(), chunks, 5, some)
    none = some.limit(0)
    assert plain(ft.search(asked, index, 5, passing=none)) == [] and plain(ft.search(asked.limit(0), index, 5)) == []


def test_rare_terms_leave_spans_out_and_no_text_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ft, "SPAN", 50)
    rows = [(i, "el " * (1 + i % 7) + ("joya " * 3 if i in (5, 6, 7, 400) else "")) for i in range(1000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    ft.write(ft.build(chunks, FIELDS), str(tmp_path))
    index = ft.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "el"), (1, "joya")], "query_id long, term string")
    names = []
    monkeypatch.setattr(ft, "kept", lambda df, name, f=ft.kept: names.append((name, f(df, name))) or names[-1][1])
    got = ft.search(asked, index, 4)
    assert [x.chunk_id for x in got.orderBy("rank").collect()] == [x[2] for x in brute(spark, asked, chunks, 4)] == sorted((5, 6, 7, 400), key=lambda i: i % 7)
    assert dict(names)["other spans"].count() == 0 and dict(names)["bounds"].count() == 20
    scanned = got._jdf.queryExecution().toString()
    assert "content" not in scanned


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id long, content string")
    ft.write(ft.build(empty), str(tmp_path))
    asked = spark.createDataFrame([(1, "el")], "query_id long, term string")
    assert ft.search(asked, ft.load(spark, str(tmp_path))).count() == 0
