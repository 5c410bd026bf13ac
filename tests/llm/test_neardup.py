import random
import re

import pytest

from codeweft.llm import neardup
from codeweft.llm.neardup import class_pairs, groups, id_pairs, shingles


def brute(rows, t=0.55):
    sets = []
    for i, b in {r[:2] for r in rows}:
        if i is None or b is None:
            continue
        w = re.findall(r"[a-z0-9_]+", "".join(c.lower() if c.isascii() else c for c in b))
        if len(w) >= 40:
            sets.append((i, b, set(zip(w, w[1:], w[2:]))))
    out = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, b, s), (j, c, u) = sets[x], sets[y]
            if i != j and b != c and len(s & u) / len(s | u) >= t:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    head = [rng.choice(vocab) for _ in range(12)]
    rows, key = [], 0
    for _ in range(n // 5):
        base = head + [rng.choice(vocab) for _ in range(rng.randrange(30, 150))]
        for k in range(5):
            w = list(base)
            for _ in range(rng.randrange(0, 3 + 4 * k)):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(3)
            if rng.random() < 0.3:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            rows.append((key, " ".join(w), "python"))
            key += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(1000 + k, rows[3][1], "x") for k in range(20)]  # exact copies
    rows += rows[:4] + [(2000, None, "x"), (2001, "", "x"), (None, rows[0][1], "x"), (2002, "Kelvin K " * 50, "x"), (2003, "a b " * 30, "x"), (2004, "A-B " * 31, "x"), (2005, ("long " + rows[1][1] + " ") * 300, "x")]
    df = spark.createDataFrame(rows, "id long, body string, node string").repartition(3)
    members, hits = class_pairs(df, "id", "body")
    got = {(r.id_a, r.id_b) for r in id_pairs(members, hits).collect()}
    assert got == brute(rows)
    group = {r.id: r for r in groups(members, hits).collect()}
    assert {i for p in got for i in p} <= set(group) and all(1000 + k in group for k in range(20))
    for a, b in got:
        assert group[a].group_id == group[b].group_id


def test_empty(spark):
    df = spark.createDataFrame([], "id long, body string")
    members, hits = class_pairs(df, "id", "body")
    assert id_pairs(members, hits).count() == 0 and groups(members, hits).count() == 0


def test_words_are_ascii():
    assert shingles("x " * 39) is None and len(shingles("x " * 40)) == 1
    assert (shingles("Ab c_1 é " * 20) == shingles("ab C_1 ß " * 20)).all()


def test_frequent_shingles_are_dealt_out(spark, monkeypatch):
    """The pairs are the same when frequent shingles are salted."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = [" ".join(base[: 60 - i % 9] + [f"x{i % 5}", f"y{i % 3}"]) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")
    pairs = lambda: {(r.id_a, r.id_b, round(r.jaccard, 9)) for r in neardup.id_pairs(*neardup.class_pairs(df, "id", "body")).collect()}
    plain = pairs()
    monkeypatch.setattr(neardup, "SALT_TEXTS", 2)
    assert pairs() == plain and len(plain) > 100
