import numpy as np

from codeweft.llm.neighbours import Graph, recall, similar, within


def test_graph_recall_and_bytes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 32))
    x = np.repeat(centres, 8, axis=0) + 0.2 * rng.normal(size=(2400, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = Graph.from_bytes(32, Graph(x).to_bytes())
    found, _ = g.search(x, 6)
    top = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, top)]) > 0.95


def tables(spark, rows):
    v = spark.createDataFrame(rows, "symbol_id long, store_id long, embedding array<float>, dim string, node int")
    s = spark.createDataFrame([(0, "M", 3, 99), (1, "M", 3, 0), (2, "M", 2, 1)], "store_id long, magic string, dim int, count long")
    return v, s


def test_dirty_rows_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 2, [1.0, 0.01 * i, 0.0]) for i in range(1, 8)]
    rows = good + good[:2] + [(10 + i, 0, [5.0, 5.0, 5.0]) for i in range(9)] + [(30, 0, None), (31, 0, [1.0]), (32, 0, [nan, 1.0, 0.0]), (33, 0, [inf, 1.0, 0.0]), (34, 0, [0.0, 0.0, 0.0]), (35, 0, [1.0, None, 0.0]), (36, 2, [1.0, 2.0]), (None, 0, [1.0, 1.0, 1.0]), (37, 9, [1.0, 1.0, 1.0])]
    v, s = tables(spark, [(*r, "x", 1) for r in rows])
    out = similar(v, s).collect()
    by = {}
    for r in out:
        assert r.id != r.other
        by.setdefault(r.id, []).append((r.place, r.other, r.cosine))
    assert set(by) == set(range(1, 8)) | set(range(10, 19))
    assert [o for _, o, _ in sorted(by[10])] == [11, 12, 13, 14, 15]
    assert [o for _, o, _ in sorted(by[18])] == [10, 11, 12, 13, 14] and all(c == 1.0 for _, _, c in by[18])
    assert all(len(x) == 5 for x in by.values())
    pairs = {(r.id_a, r.id_b) for r in within(similar(v, s), 0.9999).collect()}
    assert (10, 18) in pairs and all(a < b for a, b in pairs)
    assert similar(v.where("false"), s).count() == 0


def test_shards_are_merged(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), 0, [float(y) for y in x], "x", 1) for i, x in enumerate(rng.normal(size=(400, 3)))]
    v, s = tables(spark, rows)
    got = recall(similar(v, s, shard_rows=64), v, s, one_in=5).collect()[0]
    assert got["n_expected"] == 400 and got["recall"] >= 0.97


def test_all_vectors_of_a_symbol_take_part(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 0, [1.0, 0.1, 0.0]), (3, 0, [0.0, 1.0, 0.1]), (4, 0, [0.0, 0.0, 1.0])]
    v, s = tables(spark, [(*r, "x", 1) for r in rows])
    got = {}
    for r in similar(v, s, k=2).collect():
        got.setdefault(r.id, {})[r.other] = r.cosine
    assert set(got[1]) == {2, 3} and all(len(x) == 2 for x in got.values())
    assert {(r.id_a, r.id_b) for r in within(similar(v, s, k=2), 0.99).collect()} == {(1, 2), (1, 3)}
    assert recall(similar(v, s, k=2), v, s, k=2, one_in=1).collect()[0]["recall"] == 1.0


def test_cells_keep_the_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 3))
    x = np.repeat(centres, 40, axis=0) + 0.1 * rng.normal(size=(2400, 3))
    v, s = tables(spark, [(int(i), 0, [float(y) for y in r], "x", 1) for i, r in enumerate(x)])
    got = recall(similar(v, s, shard_rows=100, probes=4), v, s, one_in=5).collect()[0]
    assert got["n_expected"] == 2400 and got["recall"] >= 0.95
