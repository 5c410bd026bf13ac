import datetime as dt

import numpy as np
from conftest import SF

from codeweft.catalogue import CORE
from codeweft.operators import blocks, enrich, memory, ranking
from codeweft.plans import more_queries
from codeweft.plans.search_queries import tasks
from codeweft.sources.tables import observations


def brute(ids, vectors, asked, k, least):
    """The best k of each asked vector, one by one."""
    out = set()
    for q, x in asked:
        s = sorted((-round(float(np.dot(np.float64(v), np.float64(x))), 6), i) for i, v in zip(ids, vectors))
        out |= {(q, i, place + 1, -c) for place, (c, i) in enumerate(s[:k]) if -c >= least}
    return out


def test_nearest_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).astype("float32")
    v[40:] = v[0]  # equal ones
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    near = blocks.nearest(df, df.where("id < 9").withColumnRenamed("id", "query_id"), 5, 0.0, block_rows=7)
    got = {(r.query_id, r.id, r.place, r.similarity) for r in memory.rank_similar(near, 5, 0.0).collect()}
    assert got == brute(range(60), v, [(i, v[i]) for i in range(9)], 5, 0.0)


def test_r21_compares_all(spark):
    got = {(r.query_id, r.id, r.place, r.similarity) for r in more_queries.r21_memory(spark, SF).collect()}
    e = enrich.HashEmbedder()
    o = memory.live(observations(spark, SF), dt.datetime(2024, 9, 1)).where("content IS NOT NULL").select("id", "content").collect()
    q = tasks(spark, SF).collect()
    want = brute([r.id for r in o], e.embed([r.content for r in o]), list(zip([r.query_id for r in q], e.embed([r.task for r in q]))), 20, 0.3)
    assert want and got == want


def test_consolidate_over_sessions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 3)).astype("float32")
    x[50:] = x[rng.integers(0, 20, 20)]
    base = dt.datetime(2024, 1, 1)
    rows = [(f"o{i:02}", f"s{i % 9}" if i % 10 else None, f"t{i}", base + dt.timedelta(minutes=i // 2), "auto", None, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, session_id string, content string, created_at timestamp_ntz, kind string, expires_at timestamp_ntz, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    free, want = list(range(70)), set()
    while free:
        lead = free[0]
        near = [i for i in free if i == lead or u[lead] @ u[i] >= 0.9]
        free = [i for i in free if i not in near]
        if len(near) > 1:
            want.add((f"o{lead:02}", len(near), tuple(f"o{i:02}" for i in near), "\n".join(f"t{i}" for i in near)))
    got = {(r.leader, r.n, tuple(r.members), r.content) for r in memory.consolidate(df, base, 0.9).collect()}
    assert want and got == want


def test_r09_asks_all_stores(spark):
    v = spark.read.parquet(f"{SF}/symbol_embeddings.parquet").collect()
    dims = {r.store_id: r.dim for r in spark.read.parquet(f"{SF}/embedding_store.parquet").collect()}
    ok = {(r.symbol_id, tuple(r.embedding)) for r in v if r.symbol_id is not None and r.embedding and len(r.embedding) == dims.get(r.store_id) and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    want = set()
    for dim in set(dims.values()):
        own = [(i, x) for i, x in ok if len(x) == dim]
        want |= brute([i for i, _ in own], [x for _, x in own], [(i, x) for i, x in own if i % 50 == 0], 25, -9)
    got = {(r.query_id, r.id, r.rank, r.similarity) for r in CORE.queries["r09_semantic_topk_all"](spark, SF).collect()}
    assert {len(x) for i, x in ok if i % 50 == 0} >= {64} and got == want


def test_topk_of_several_dimensions_and_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0])], "id long, embedding array<float>")
    got = sorted((r.query_id, r.id, r.rank, r.similarity) for r in ranking.semantic_topk(df, df.where("id = 1").withColumnRenamed("id", "query_id"), 2).collect())
    assert got == [(1, 1, 1, 1.0), (1, 1, 1, 1.0), (1, 2, 2, 0.8), (1, 3, 2, 0.0)]
