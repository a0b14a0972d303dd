import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrid.llm import negatives, spectral, whitening


def brute_negatives(rows):
    """rows: (id, vector, label), whole lists."""
    part = [
        (i, [min(max(math.floor(256 * x), -(1 << 26)), 1 << 26) for x in v], y)
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, v, y) in enumerate(part):
        if i is None or i % 10:
            continue
        scored = sorted(
            ((sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, z) for m, (j, w, z) in enumerate(part) if m != n and len(w) == len(v)),
            key=lambda t: (-t[0], t[1]),
        )
        for ps, pid, _ in [t for t in scored if t[2] == y][:5]:
            near = [t for t in scored if t[2] != y and 80 * ps <= 100 * t[0] <= 100 * ps][:5]
            out += [(i, pid, k, j, ps, s) for k, (s, j, _) in enumerate(near, 1)]
    clean = lambda x: None if x == math.inf else x
    return sorted((tuple(map(clean, r)) for r in out), key=repr)


def mined(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int, rid int, x int, piece string")
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, small, monkeypatch):
    if small:  # many cells, pieces and seeds
        for name, value in (("CELL_ROWS", 8), ("PIECE_ROWS", 5), ("SEED_ROWS", 12), ("AT_ONCE", 3)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(9)
    heads = rng.normal(size=(6, 10))
    rest = (0, 0, "x")
    rows = [(i, (heads[i % 6] + rng.normal(size=10) * rng.choice([0.05, 0.5])).tolist(), int(rng.integers(4)), *rest) for i in range(300)]
    rows += [(300 + i, heads[0].tolist(), i % 3, *rest) for i in range(90)]  # copies: ties
    rows += [(0, heads[1].tolist(), 1, *rest), (10, rows[10][1], rows[10][2], *rest), (None, heads[2].tolist(), 2, *rest)]
    rows += [(500, None, 1, *rest), (510, [1.0] * 9 + [None], 1, *rest), (520, [1.0] * 9 + [float("nan")], 1, *rest), (530, [float("inf")] * 10, 1, *rest), (540, heads[0].tolist(), None, *rest)]
    rows += [(600 + i, [1.0, 0.5 + i / 10, 0.2], i % 2, *rest) for i in range(20)] + [(700 + i, [], i % 2, *rest) for i in range(3)] + [(710, [2.0], 0, *rest), (711, [2.0], 1, *rest)]
    rows += [(800, [-v for v in heads[0].tolist()], 99, *rest), (810, [1e300] * 5, 1, *rest), (811, [-1e300] * 5, 1, *rest), (812, [2e5] * 5, 2, *rest)]
    assert mined(spark, rows) == brute_negatives([r[:3] for r in rows])


def test_negatives_of_many_lengths_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BOOKS", 1)
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=3 + i % 4).tolist(), i % 3, 0, 0, "x") for i in range(120)]
    want = brute_negatives([r[:3] for r in rows])
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(0, None, None, 0, 0, "x")]) == []


def test_visits_stop_at_the_floor_and_miss_nothing():
    rng = np.random.default_rng(4)
    x = np.round(np.repeat(rng.normal(size=(30, 8)) * 500, 20, axis=0) + rng.normal(size=(600, 8)) * 20)
    c1, c2 = (negatives.codebook(h, 12, 1) for h in negatives._halves(x))
    i, j = (negatives._nearest(h, c) for h, c in zip(negatives._halves(x), (c1, c2)))
    cell = (1 << 16) + (i << 8) + j
    radii = [negatives._norms(h - c[k]) for h, c, k in zip(negatives._halves(x), (c1, c2), (i, j))]

    class Row:
        def __init__(self, c):
            at = cell == c
            self.cell, self.n, self.r1, self.r2 = int(c), int(at.sum()), radii[0][at].max(), radii[1][at].max()

    index = negatives.Cells({8: (1, c1, c2)}, [Row(c) for c in np.unique(cell)])
    a = x[::50]
    scores = a @ x.T
    floors = np.sort(scores, axis=1)[:, -15].astype(float)
    least = []
    for k, cells in index.visited(a, 8, floors, 0):
        assert set(cell[scores[k] >= floors[k]]) <= set(cells)
        least.append(np.isin(cell, cells).sum())
    assert np.mean(least) < 200  # of 600: the bounds do prune
    for k, cells in index.visited(a, 8, np.full(len(a), -1e18), 100):
        assert 100 <= np.isin(cell, cells).sum() < 600
    for k, cells in index.visited(a, 8, np.full(len(a), -1e18), 0):
        assert set(cells) == set(cell)


def spectra(rng):
    basis = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    many = {
        "zero": np.zeros(24), "equal": np.full(24, 3.0), "pairs": np.repeat(np.arange(1.0, 13), 2), "four": np.repeat([1.0, 2, 3, 4], 6),
        "deficient": np.r_[np.arange(1.0, 6), np.zeros(19)], "wide": np.logspace(0, -14, 24), "close": 1 + 1e-10 * np.arange(24), "both signs": np.linspace(-5, 5, 24), "one": np.r_[1e12, np.ones(23)],
    }
    for name, e in many.items():
        yield name, (basis * e) @ basis.T
    for n in (1, 2, 3, 40):
        yield f"random {n}", np.cov(rng.normal(size=(n, 3 * n + 5)), bias=True).reshape(n, n)
    yield "diagonal", np.diag(np.arange(24.0))


def test_spectral_divide_and_conquer():
    for name, a in spectra(np.random.default_rng(3)):
        e, v = spectral.spectral(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-14, name
        assert np.abs(a @ v - v * e).max() < 1e-14 * size, name
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * size, name


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = np.cov(rng.normal(size=(30, 50))) - np.eye(30)
    w, q = np.linalg.eigh(a)
    assert np.abs(spectral.polar_factor(a) - (q * np.sign(w)) @ q.T).max() < 1e-12


def test_whitening(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40)) * 3
    x[100:180] = x[0]  # a group of copies
    kept = [(i, v.tolist(), "k", 1) for i, v in enumerate(x)] + [(7, x[3].tolist(), "k", 1), (None, x[4].tolist(), "k", 1), (900, [1e300] * 40, "k", 1)]
    gone = [(901, None, "", 0), (902, [None] + [1.0] * 39, "", 0), (903, [float("nan")] * 40, "", 0), (904, [float("inf")] * 40, "", 0), (905, [], "", 0), (906, [1.0, 2.0], "", 0)]
    got = whitening.whitened(spark.createDataFrame(kept + gone, "vec_id long, embedding array<double>, n string, component int").repartition(5)).collect()
    n = len(kept)
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    whole = [[max(-(1 << 24), min(1 << 24, math.floor(64 * c))) + 1_000_000 for c in r[1]] for r in kept]
    sums = [sum(c) for c in zip(*whole)]
    off = [[n * c - s for c, s in zip(r, sums)] for r in whole]
    centred = np.array(off) / n
    v = centred.T @ centred / n
    e = np.linalg.eigvalsh(v)[::-1]
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    total = lambda o: s if (s := sum(c * c for c in o)) < 1 << 63 else None
    assert sorted((repr((r[0], total(o))) for r, o in zip(kept, off))) == sorted(repr(k) for k, rs in by_row.items() for _ in range(len(rs) // 32))
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-4
    for c in range(1, 33):
        z = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c}
        col = np.array([z[(r[0], total(o))] for r, o in zip(kept, off)])
        assert abs(col.mean()) < 1e-6 and abs((col * col).mean() - 1) < 1e-4
        direction = centred.T @ col / n / math.sqrt(e[c - 1])  # V u = e u
        assert np.abs(v @ direction - e[c - 1] * direction).max() < 1e-9 * e[0] and abs(np.linalg.norm(direction) - 1) < 1e-6
        share = {r.explained for r in got if r.component == c}
        assert len(share) == 1 and abs(share.pop() / (e[c - 1] / np.trace(v)) - 1) < 1e-4


def test_whitening_of_little_or_nothing(spark):
    kind = "vec_id string, embedding array<float>"
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert run([]) == [] and run([("a", None)]) == [] and run([("a", [])]) == [] and run([("a", [1.0, 2.0])] * 3) == []
    got = sorted(run([("a", [1.0, 5.0]), ("b", [2.0, 5.0]), ("c", [3.0, 5.0])]))
    assert [(r.vec_id, r.component, r.n, r.deviation, r.explained) for r in got] == [("a", 1, 3, 192**2, 1.0), ("b", 1, 3, 0, 1.0), ("c", 1, 3, 192**2, 1.0)]
    assert np.allclose(sorted(r.whitened for r in got), [-(1.5**0.5), 0, 1.5**0.5]) and got[0].identity_error < 1e-12


def test_products_beyond_doubles():
    y = np.array([[1 << 25, 3], [-(1 << 25), 5], [(1 << 25) - 1, 7]] * 50)
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(2)] for i in range(2)]
    assert sum(g.astype(object) for g in whitening._products(y)).tolist() == want
