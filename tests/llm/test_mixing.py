import hashlib
import re
from collections import Counter, defaultdict

import pytest

from notegrid.llm import mixing
from tests.llm.data import documents, frame, prose


def brute_targets(sizes, percent=1.5, times=2):
    """sizes: source -> words. Resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), percent * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if target[s] < times * sizes[s]]
        if not open_:
            break
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - times * sizes[s]) for s in names)
        target = {s: min(t, times * sizes[s]) for s, t in target.items()}
    return target


def brute_taken(rows, block, percent=1.5, seed=12):
    """(id, size, source size, target, taken) by laying out every block word by word."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size):
        sizes[r[3]] += n
    target, got = brute_targets(sizes, percent), Counter()
    for s in sizes:
        stream = []
        for part in range(2):
            key = lambda k: (hashlib.md5(f"{seed}:{part}:{'' if rows[k][0] is None else rows[k][0]}:{size[k]}".encode()).hexdigest(), rows[k][0] or 0, size[k])  # noqa: B023, E731
            for k in sorted((k for k in range(len(rows)) if rows[k][3] == s), key=key):
                stream += [k] * size[k]
        quota = int(target[s] + 0.5)
        for a in range(0, quota, block):
            got.update(stream[a : min(a + block, quota)])
    return sorted(((r[0], n, sizes[r[3]], round(target[r[3]], 6), got[k]) for k, (r, n) in enumerate(zip(rows, size))), key=repr)


def plain(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 7])
def test_mixing(spark, block):
    rows = documents(72)
    rows += [rows[20], rows[20], (None, prose(__import__("random").Random(1), 40), None, "b", *[None] * 6)]  # repeated rows and a null id
    rows += [(1000 + i, "uno dos\ttres\x0bcuatro cinco 　", None, s, *[None] * 6) for i, s in enumerate(["", "￿", "\U0001f600", "Z", "z", "tiny"])]
    rows += [(1100, " \n ", None, "empty", *[None] * 6)]
    got = plain(mixing.taken(frame(spark, rows).repartition(5), block_words=block))
    assert got == brute_taken(rows, block)
    assert got == plain(mixing.taken(frame(spark, rows[::-1]), block_words=block))
    assert all(t <= 2 * n for _, n, _, _, t in got)


@pytest.mark.parametrize("percent", [30, 200, 400])
def test_other_shares(spark, percent):
    rows = documents(48)
    got = plain(mixing.taken(frame(spark, rows), percent=percent, block_words=50))
    assert got == brute_taken(rows, 50, percent / 100)


def test_mixing_nothing(spark):
    assert mixing.taken(frame(spark, [])).count() == 0
    got = mixing.taken(frame(spark, [(1, None, None, None, *[None] * 6), (None, "", None, "a", *[None] * 6)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_slots_spread_evenly_and_hold_whole_blocks(spark):
    rows = documents(60) + [(2000 + i, "uno " * 90, None, f"s{i % 5}", *[None] * 6) for i in range(60)]
    docs, slots, pieces = mixing.mix(frame(spark, rows), block_words=16)
    info = {r.row_key: (r.source or "", r.size) for r in docs.collect()}
    slot = {r.slot: (r.number, r.rank) for r in slots.collect()}
    assert len(slot) == slots.count()
    counts = Counter(n for n, _ in slot.values())
    by_number = defaultdict(list)
    for t, (n, r) in sorted(slot.items()):
        by_number[n].append(r)
    assert all(r == list(range(len(r))) for r in by_number.values())  # the r-th slot of a source has rank r
    filled, parts = Counter(), defaultdict(set)
    for p in pieces.collect():
        filled[p.slot] += p.words
        assert 0 <= p.first_word and p.first_word + p.words <= info[p.row_key][1]
        parts[p.slot].add(info[p.row_key][0])
    assert all(len(s) == 1 for s in parts.values()) and set(filled) == set(slot)
    assert all(filled[t] == 16 or r == counts[n] - 1 for t, (n, r) in slot.items())
    order, seen, total = sorted(slot), Counter(), len(slot)
    for done, t in enumerate(order, 1):
        seen[slot[t][0]] += 1
        for n, c in counts.items():  # any start of the mix is near the mixture
            assert abs(seen[n] - done * c / total) <= 1 + total.bit_length()


def test_reversed_bits(spark):
    from pyspark.sql import functions as F

    got = spark.range(64).select(mixing._reversed_bits(F.col("id"), F.lit(6)).alias("r")).collect()
    assert [r.r for r in got] == [int(f"{i:06b}"[::-1], 2) for i in range(64)]
