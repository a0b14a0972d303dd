"""Small inputs with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "vi") for c in ("", "n", "rel", "stu")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, fp long, d long, kind string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(n=60, seed=1):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = i % 12
        if kind == 3:
            t = None
        elif kind == 4:
            t = ""
        elif kind == 5 and texts:
            t = rng.choice(texts)
        elif kind == 6 and texts:
            w = (rng.choice(texts) or "x y").split()
            w[rng.randrange(len(w))] = "cambio"
            t = "\t".join(w)
        elif kind == 7 and texts:
            t = prose(rng, 30) + "\n" + rng.choice(texts) + " " + prose(rng, 10)
        elif i == 20:
            t = prose(rng, 30_000)
        else:
            t = prose(rng, rng.choice([1, 3, 19, 20, 21, 60, 150]))
        if t:
            texts.append(t)
        rows.append((i * 3, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "b", None]), len(t or ""), "x", "y", 1, 2, "z"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
