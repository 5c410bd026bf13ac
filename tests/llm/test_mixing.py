import collections

import numpy as np
import pytest

from codeweft.llm import mixing, tokens


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    a, b = (mixing.permute(np.arange(n), n, k) for k in (1, 2))
    assert sorted(a) == list(range(n)) == sorted(b)
    assert n < 60 or (a != b).any()


def test_quotas_and_deal():
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 1), ("gone", 0.0, 1)]
    q = mixing.quotas(targets, {"a": 1000, "b": 100, "c": 900}, 10)
    total = sum(q.values())
    assert q["b"] <= 40 and all(abs(q[s] - w * total) <= 1 for s, w, _ in targets[:3])
    plan = mixing.deal(q, 5)
    assert all(sum(plan[s, k][1] for k in range(5)) == q[s] for s in q)
    sizes = [sum(plan[s, k][1] for s in q) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    big = mixing.quotas(targets, {"a": 1000, "b": 100, "c": 900}, 10, tokens=5000)
    assert big["a"] == 100 and big["b"] == 40 and big["c"] == 90
    assert mixing.quotas(targets, {}, 10) == {}


def test_mixture(spark):
    docs = [(i, f"text number {i} " * (1 + i % 7), src, i) for i in range(300) for src in (["Big-One"] if i % 3 else [" small one "])]
    docs += [(900, None, "big_one", 1), (901, "", "big_one", 1), (902, "x y", None, 1), (903, "x y", "unlisted", 1), (1, "text number 1 " * 2, "Big-One", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, block long")
    mix = spark.createDataFrame([("big_one", 0.4, 1, 1), ("small_one", 0.5, 3, 1), ("absent", 0.1, 2, 1), (None, 0.3, 1, 1)], "source string, target_share double, max_repeats int, ids int")
    mixed, report = mixing.mixture(df, mix, block=16, shards=3)
    rows = mixed.collect()
    lines = {r.source: r for r in report.collect()}
    assert set(lines) == {"big_one", "small_one", "absent"} and lines["absent"].tokens == 0
    uses = collections.Counter((r.source, r.block) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "big_one") <= 1 and max(uses.values()) <= 3
    assert {r.source for r in rows} == {"big_one", "small_one"} and all(len(r.ids) == 16 for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(3) for i in range(sum(x.shard == k for x in rows))]
    got = collections.Counter(r.source for r in rows)
    assert abs(got["small_one"] / len(rows) - 5 / 9) < 0.02 and sum(got.values()) * 16 == sum(x.tokens for x in lines.values())
    again = mixing.mixture(df.repartition(5), mix, block=16, shards=3)[0].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    # a source's blocks are its documents' tokens, end to end
    blocks = {r.block: r for r in mixing.blocks_of(mixing.pack(df).where("source = 'big_one'"), 16).collect()}
    flat = [t for b in sorted(blocks) for t in blocks[b].ids]
    expected = sum(len(tokens.codec().encode(t)) for _, t, s, _ in docs if s == "Big-One")
    assert len(flat) == expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(df, mix)
    assert mixed.count() == 0 and report.count() == 0


@pytest.mark.parametrize("good,bad,n", [(7, 5, 4), (3, 0, 2), (0, 9, 3), (40, 60, 100), (1000, 9000, 500), (5, 5, 0)])
def test_draws_have_the_right_chances(good, bad, n):
    rng, other = np.random.default_rng(1), np.random.default_rng(2)
    got = np.array([mixing._draw(rng, good, bad, n) for _ in range(4000)])
    ref = other.hypergeometric(good, bad, n, 4000) if n and good else np.zeros(4000)
    assert abs(got.mean() - ref.mean()) < 0.15 + 0.02 * ref.mean() and abs(got.std() - ref.std()) < 0.1 + 0.06 * ref.std()
    assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)


def test_draws_of_very_many():
    rng = np.random.default_rng(1)
    got = [mixing._draw(rng, 3 * 10**10, 7 * 10**10, 10**10) for _ in range(20)]
    assert abs(np.mean(got) / 10**10 - 0.3) < 1e-4 and len(set(got)) > 10


def test_parts_make_one_line(spark):
    """However a source is parted, its blocks are the same tokens in number, and a long document is cut into many."""
    docs = [(i, "some words of text " * (1 + i % 9), "a") for i in range(60)] + [(99, "very long text, " * 3000, "a"), (7, "some words of text " * 8, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    total = sum(len(tokens.codec().encode(t)) for _, t, _ in docs)
    for part_tokens in (64, 1 << 22):
        rows = mixing.blocks_of(mixing.pack(df, part_tokens=part_tokens), 32).orderBy("block").collect()
        assert [r.block for r in rows] == list(range(-(-total // 32)))
        assert all(len(r.ids) == 32 for r in rows[:-1]) and sum(len(r.ids) for r in rows) == total
        assert len({d for r in rows for d in r.doc_ids}) == 61
