"""Exact comparison of all vectors of one table with all of another, in blocks.

Every block of the left side meets every block of the right side of the same dimension; a block is bounded, so is what a task
holds, and only what a task keeps travels on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.plans.materialize import materialize

#: Vectors of a block, and left vectors that are compared at once.
BLOCK_ROWS, STEP = 8192, 256


def meet(left: DataFrame, right: DataFrame, run, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``run(left, right)`` over all pairs of blocks; both sides have ``id`` and ``embedding``."""
    sides = [materialize(df.withColumn("size", F.size("embedding")).where("size > 0"), name) for df, name in ((left, "left"), (right, "right"))]
    n = [max(1, -(-df.count() // block_rows)) for df in sides]
    block = lambda i: F.pmod(F.xxhash64("id"), F.lit(n[i])).cast("int")
    every = lambda i: F.explode(F.sequence(F.lit(0), F.lit(n[i] - 1)))
    a = sides[0].withColumn("a", block(0)).withColumn("b", every(1))
    b = sides[1].withColumn("b", block(1)).withColumn("a", every(0))
    return a.groupBy("size", "a", "b").cogroup(b.groupBy("size", "a", "b")).applyInPandas(run, schema)


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in rows])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``size``, ``id``, ``similarity`` (dot product, 6 decimals): the best k ids of each query and dimension in every
    block, equal ones by the smaller id; at least ``least`` where that is given. The best k of all are among them.

    Of several vectors of an id the nearest counts, on either side. Products that are NaN are left out."""
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable")
            x, y, q, size = matrix(left["embedding"]), matrix(right["embedding"]), left["id"].to_numpy(), left["size"].iloc[0]
            ids, starts = np.unique(right["id"].to_numpy(), return_index=True)  # an id's vectors lie side by side, and in one block
            for at in range(0, len(x), STEP):
                s = np.round(x[at : at + STEP] @ y.T, 6)
                s[np.isnan(s)] = -np.inf
                if len(starts) < s.shape[1]:
                    s = np.maximum.reduceat(s, starts, axis=1)
                floor = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf
                r, c = np.nonzero((s >= floor) & (s > -np.inf) & (s >= (-np.inf if least is None else least)))
                order = np.lexsort((c, -s[r, c], r))
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)
                keep = np.arange(len(r)) - first < k
                r, c = r[keep], c[keep]
                out.append(pd.DataFrame({"query_id": q[at + r], "size": size, "id": ids[c], "similarity": s[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "size": [], "id": [], "similarity": []})

    met = meet(queries.select(F.col("query_id").alias("id"), "embedding"), vectors.select("id", "embedding"), run, f"query_id {kinds[0]}, size int, id {kinds[1]}, similarity double", block_rows)
    return met.groupBy("query_id", "size", "id").agg(F.max("similarity").alias("similarity"))


def links(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a``, ``b``: the ids of vectors (``id``, ``t``, ``embedding``) with at least this cosine (6 decimals), the earlier one by (``t``, ``id``) first."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (matrix(left["embedding"]), matrix(right["embedding"])))
            p, q, s, t = left["id"].to_numpy(), right["id"].to_numpy(), left["t"].to_numpy(np.int64), right["t"].to_numpy(np.int64)
            for at in range(0, len(x), STEP):
                r, c = np.nonzero(np.round(x[at : at + STEP] @ y.T, 6) >= threshold)
                r = r + at
                keep = (s[r] < t[c]) | ((s[r] == t[c]) & (p[r] < q[c]))
                out.append(pd.DataFrame({"a": p[r[keep]], "b": q[c[keep]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    slim = materialize(vectors.select("id", "t", "embedding"), "vectors")
    return meet(slim, slim, run, f"a {kind}, b {kind}", block_rows)
