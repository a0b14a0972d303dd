import hashlib
import re

import numpy as np
import pytest
import xxhash

from notegrid.llm import cells, pivots, rlz, shingles, simhash
from notegrid.llm.components import components
from tests.llm.data import documents, frame, prose


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_components(spark, sent, monkeypatch):
    from notegrid.llm import components as stars
    from notegrid.llm.common import shared_checkpoints

    monkeypatch.setattr(stars, "SENT_NODES", sent)

    shared_checkpoints(spark)
    pairs = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (7, 8), (8, 7), (130, 39)]
    pairs, loops = [p for p in pairs if p[0] != p[1]], [p for p in pairs if p[0] == p[1]]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + loops, "a long, b long")).collect()}
    want = roots(pairs, {x for p in pairs for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_simhash(rows):
    prints = {}
    for i, t, *_ in rows:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h)) if h else 0
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    return prints, roots(pairs, prints)


@pytest.mark.parametrize("limit", [8192, 2])
def test_simhash(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_ROWS", limit)
    rows = documents(60)
    rows += [(1000 + i, rows[20][1].replace("ka", "KA", i), None, "b", 0, "", "", 0, 0, "") for i in range(3)]
    base = rows[20][1].split()
    for i in range(12):  # near copies of one text
        w = list(base)
        w[i * 7] = "otra"
        rows.append((2000 + i, " ".join(w), None, "b", 0, "", "", 0, 0, ""))
    prints, comp = brute_simhash(rows)
    got = simhash.near_duplicates(frame(spark, [*rows, rows[0]])).select("doc_id", simhash.as_hex("fp").alias("f"), "component_id").collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.f, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))


def test_simhash_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(None, "a", *[None] * 8), (4, None, *[None] * 8)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (4, 4)}


@pytest.mark.parametrize("limit", [1024, 3])
def test_pipeline_stage_catches_five_word_similarity(spark, limit, monkeypatch):
    import random

    import corpus_pipeline

    monkeypatch.setattr(shingles, "BUCKET_ROWS", limit)
    rng = random.Random(12)
    texts = [prose(rng, 200) for _ in range(4)]
    for base in texts[:4]:
        for changes in (1, 2, 3, 4, 4, 4, 5, 6, 8, 12):  # similarities from 0.95 down to 0.5
            w = base.split()
            for k in range(changes):
                w[10 + 15 * k] = f"otra{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [prose(rng, 3), "", None, "uno dos tres", "UNO  dos\ttres", " ".join([texts[0]] * 2)]
    rows = [(i * 2, t, *[None] * 8) for i, t in enumerate(texts)] + [(None, texts[0], *[None] * 8)]
    sets = {}
    for i, t, *_ in rows[:-1]:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    close = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    prints, op6 = brute_simhash(rows[:-1])
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in close) >= 10
    want = roots(close + list(op6.items()), sets)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, *sorted(set(want.values()))]


def test_bk_tree_finds_all():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    all_ = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    got = {(n, int(q)) for n, near in simhash.BKTree(all_).within(all_, 4) for q in near}
    assert got == {(i, j) for i in range(len(all_)) for j in range(len(all_)) if int(all_[i] ^ all_[j]).bit_count() <= 4}


def vectors(rng, n=400, d=16):
    x = rng.normal(size=(n, d))
    for i in range(0, 60):
        x[300 + i] = x[i] + rng.normal(size=d) * 0.05
    x[380:400] = x[7] * rng.uniform(0.5, 2, size=(20, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("limit", [4096, 3])
def test_pivots(spark, limit, monkeypatch):
    monkeypatch.setattr(pivots, "LIST_ROWS", limit)
    x = vectors(np.random.default_rng(5))
    rows = [(i, v.tolist(), "k", 1) for i, v in enumerate(x)]
    rows += [(900, None, "", 0), (901, [0.0] * 16, "", 0), (902, [float("nan")] * 16, "", 0), (903, [], "", 0), (904, [1.0, None], "", 0), (905, [1.0, 2.0], "", 0), (906, [float("inf")] * 16, "", 0)]
    rows += [(1, x[1].tolist(), "", 0), (907, x[1].tolist(), "", 0)]  # a repeated row and a copy
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, rep int")).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows if r[1] and len(r[1]) == 16 and r[0] not in (901, 902, 906)]
    m = np.array([r[1] for r in rows if r[1] and len(r[1]) == 16 and r[0] not in (901, 902, 906)], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    found = sum(r.n_links for r in got)
    assert 0.9 * near.sum() <= found <= near.sum()
    comp = roots([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if ids[a] != ids[b]], set(ids))
    right = sum(r.component_id == comp.get(r.vec_id, r.vec_id) for r in got)
    assert right >= 0.95 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and all(r.n_links == 0 for r in got if r.vec_id in (900, 901, 902, 903, 904, 905, 906))
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("limit", [4096, 50])
def test_pivots_of_a_cone_and_of_few_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(pivots, "LIST_ROWS", limit)
    rng = np.random.default_rng(6)
    cone = np.eye(16)[0] + rng.normal(size=(300, 16)) * 0.1  # cosines of about 0.87
    cone[200:] = cone[:100] + rng.normal(size=(100, 16)) * 0.02
    near = [[1.0, 0.1, 0.0], [1.0, 0.12, 0.0]]
    cases = [cone.tolist(), near, near[:1], cone.tolist() + near]
    for k, case in enumerate(cases):
        if k == 3:
            monkeypatch.setattr(pivots, "PIVOTS", (2, 2))  # so that hardly any length has a sampled pivot
            case = case + [[*v, *v] for v in near] + [[2.0] * d for d in range(20, 40)] + [[2.1] * (d - 1) + [2.0] for d in range(20, 40)]
        got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(list(enumerate(case)), "vec_id long, embedding array<double>")).collect()}
        unit = [np.array(v) / np.linalg.norm(v) for v in case]
        pairs = [(a, b) for a in range(len(case)) for b in range(len(case)) if a != b and len(case[a]) == len(case[b]) and unit[a] @ unit[b] >= 0.95]
        comp = roots([p for p in pairs if p[0] < p[1]], range(len(case)))
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (sum(a == i for a, _ in pairs), comp[i]) for i in range(len(case))}


def test_pivots_where_all_vectors_are_alike(spark):
    rng = np.random.default_rng(7)
    x = np.eye(32)[0] * 1.6 + rng.normal(size=(1500, 32)) * 0.2  # cosines of about 0.5 and more
    x[1200:] = x[:300] + rng.normal(size=(300, 32)) * 0.02
    rare = [[1.0, 0.1, 0.0], [1.0, 0.12, 0.0], [0.0, 1.0], [0.1, 1.0], [0.0, 1.0, 0.0]]
    case = x.tolist() + rare
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(spark.createDataFrame(list(enumerate(case)), "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    near = (sims >= 0.95).sum(1) - 1
    assert np.quantile(sims, 0.02) > 0.3 and near.sum() >= 500
    assert 0.9 * near.sum() <= sum(got[i] for i in range(1500)) <= near.sum()
    assert [got[i] for i in range(1500, 1505)] == [1, 1, 1, 1, 0]


def test_groups_of_any_batching():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5, 6]
    want = {1: 2, 3: 7, 5: 2}
    for size in (1, 2, 3, 5, 14):
        batches = [pa.RecordBatch.from_pydict({"key": keys[a : a + size], "v": list(range(a, min(14, a + size)))}) for a in range(0, 14, size)]
        seen = {}
        for group, chunk, _ in cells._groups(iter(batches), 1, 3):
            t = group if group is not None else chunk
            assert t.num_rows <= 3
            seen[t.column(0)[0].as_py()] = seen.get(t.column(0)[0].as_py(), 0) + t.num_rows
        assert seen == want


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_repeats(spark, batch):
    import random

    rng = random.Random(2)
    rows = documents(72)
    passage = prose(rng, 27)
    rows += [(500 + i, prose(rng, 9) + " " + passage + " " + prose(rng, 9), None, "", 0, "", "", 0, 0, "") for i in range(20)]
    rows += [(600, " ".join([passage] * 4), None, "", 0, "", "", 0, 0, ""), (601, "uno " * 70, None, "", 0, "", "", 0, 0, "")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rlz.drop_repeats(frame(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == brute_repeats(rows)


def test_factors(spark):
    import random

    rng = random.Random(3)
    a, b = prose(rng, 80).split(), prose(rng, 50).split()
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[10:60], *b[5:35], "fin", *a[:25]])), (None, ""), (4, None)]
    texts = {i: (t or "").split() for i, t in rows}
    got = rlz.factors(frame(spark, [(*r, *[None] * 8) for r in rows])).collect()
    for f in got:
        assert texts[f.doc_id][f.start : f.start + f.n_words] == texts[f.source_id][f.source_start : f.source_start + f.n_words]
    assert sorted((f.doc_id, f.start, f.n_words, f.source_id, f.source_start) for f in got) == [(3, 0, 50, 1, 10), (3, 50, 30, 2, 5), (3, 81, 25, 1, 0)]
    rows = documents(72)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    covered = {i: [False] * len(w) for i, w in words.items()}
    for f in rlz.factors(frame(spark, rows).repartition(5)).collect():
        assert f.n_words >= 20 and (f.source_id, f.source_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.n_words] == words[f.source_id][f.source_start : f.source_start + f.n_words]
        covered[f.doc_id][f.start : f.start + f.n_words] = [True] * f.n_words
    assert {i: sum(c) for i, c in covered.items()} == {i: r[1] for i, r in brute_repeats(rows).items()}
    assert rlz.factors(frame(spark, [])).count() == 0


def test_repeats_awkward(spark):
    long = " ".join(f"w{i}" for i in range(30))
    got = rlz.drop_repeats(frame(spark, [(5, long, *[None] * 8), (5, long, *[None] * 8), (None, long, *[None] * 8)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (5, 30), (5, 30)]
    assert rlz.drop_repeats(frame(spark, [])).count() == 0


def brute_by_row(rows):
    """Rows (id, text) of which ids may repeat: windows at (id, start), null before all."""
    key = lambda i, a: (i is not None, i or 0, a)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            first[k] = min(first.get(k, key(i, a)), key(i, a))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - 19):
            if first[tuple(w[a : a + 20])] < key(i, a):
                gone.update(range(a, a + 20))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", ["10000", "1"])
def test_rows_that_repeat_an_id_keep_what_is_theirs(spark, batch):
    import random

    rng = random.Random(6)
    a, unique = prose(rng, 30), " ".join(f"u{i}" for i in range(60))
    rows = []
    for i in (None, 9):
        rows += [(i, f"{a} {a}"), (i, unique if i is None else unique.replace("u", "v"))]
    base = prose(rng, 60).split()
    for i in (12, 12, 12, 20, None):  # texts of one id that begin alike and part later
        rows.append((i, " ".join([*base[: rng.choice([25, 31, 40])], *prose(rng, 30).split(), *base[30:]])))
    rows += [(12, rows[-3][1]), (30, ""), (30, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rlz.drop_repeats(frame(spark, [(*r, *[None] * 8) for r in rows]).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_by_row(rows)
