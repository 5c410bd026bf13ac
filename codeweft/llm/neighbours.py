"""The k most similar vectors of every vector by sharded small-world graphs (problem 2).

Identical vectors are folded into one node. The nodes of a dimension are dealt into cells: a pivot for every
``shard_rows`` nodes is drawn from the nodes themselves, so dense regions get more of them, and a node belongs to its
nearest pivot. A cell is a shard; one that came out more than twice as large is cut into several by hash. Each shard gets
a hierarchical navigable small-world graph, kept as flat neighbour arrays (one int32 matrix per level). A node is looked
up in the shards of its ``PROBES`` nearest cells (in all, as long as there are no more), so work and shuffle grow in
proportion to the nodes. Exact cosines are computed in double precision for all that the graphs return, and the shards'
answers are merged by cosine and id.

Graphs are built by batch insertion: a batch is searched in the graph so far and among itself, neighbours are picked by
the diversity rule of the published algorithm, and reverse links are added and pruned. Searches run for many queries at
once with array operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.plans.materialize import materialize

SHARD_ROWS = 65_536
LINKS = 16
BUILD_BEAM = 40
SEARCH_BEAM = 64
#: Most pivots of a dimension; they are broadcast, at most MAX_PIVOTS x dim floats.
MAX_PIVOTS = 16_384
#: Cells that a node is looked up in.
PROBES = 8
#: Queries that meet one copy of a graph.
QUERY_BLOCK_ROWS = 32_768
#: Queries searched side by side; the table of visited rows has BEAM_BLOCK x SHARD_ROWS bytes.
BEAM_BLOCK = 512
#: Members of a folded direction that its answer lists need: k others and oneself.
_SPARE = 1


def usable(vectors: DataFrame, stores: DataFrame) -> DataFrame:
    """``symbol_id``, ``dim``, ``embedding`` of the usable vectors: not null, of the length that the store states, all
    elements finite, not all zero. The store's ``count`` is not read, and repeats are still there."""
    v = vectors.select(F.col("symbol_id").cast("long").alias("symbol_id"), "store_id", F.col("embedding").cast("array<float>").alias("embedding"))
    # the stores are a few dozen rows at any size; the size of the table is left to the planner to check
    s = stores.select("store_id", F.col("dim").cast("int").alias("dim")).where("dim > 0").dropDuplicates(["store_id"])
    return (
        v.where(F.col("symbol_id").isNotNull() & F.col("embedding").isNotNull())
        .join(s, "store_id")
        .where(F.size("embedding") == F.col("dim"))
        .where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
        .select("symbol_id", "dim", "embedding")
    )


class Graph:
    """A small-world graph over the rows of a matrix of unit vectors."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, n = links, len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 6) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # upper levels first, so that entry points exist
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        top = int(level.max()) if n else 0
        for lv in range(top, -1, -1):
            members = order[: int((level >= lv).sum())]
            self.levels.append((members, self._build(members, links * 2 if lv == 0 else links, beam)))
        self.levels.reverse()

    def _build(self, members: np.ndarray, width: int, beam: int) -> np.ndarray:
        """Neighbour matrix (row numbers within ``members``, -1 for none) of one level."""
        n = len(members)
        x = self.x[members]
        links = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            size = min(n - done, max(256, done), 4096)
            fresh = np.arange(done, done + size)
            found, sims = self._among(x[fresh], fresh, min(beam, size - 1 or 1))
            if done:
                start = np.zeros((size, 1), np.int64)
                f2, s2 = beam_search(x, links, x[fresh], start, beam, done)
                found, sims = np.hstack([found, f2]), np.hstack([sims, s2])
            picked = diverse(x, found, sims, width // 2)
            links[fresh, : picked.shape[1]] = picked
            self._reverse(x, links, fresh, picked, width)
            done += size
        return links

    @staticmethod
    def _among(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of a batch for each of its own rows."""
        n = len(x)
        found, sims = np.full((n, max(k, 1)), -1, np.int64), np.full((n, max(k, 1)), -2.0, np.float32)
        if n < 2:
            return found, sims
        for a in range(0, n, 1024):
            d = x[a : a + 1024] @ x.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = -2
            top = np.argpartition(-d, min(k, n - 1) - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-d, axis=1)[:, :k]
            rows = np.arange(len(d))[:, None]
            found[a : a + len(d), : top.shape[1]] = ids[top]
            sims[a : a + len(d), : top.shape[1]] = d[rows, top]
            found[a : a + len(d)][sims[a : a + len(d)] <= -2] = -1
        return found, sims

    @staticmethod
    def _reverse(x: np.ndarray, links: np.ndarray, fresh: np.ndarray, picked: np.ndarray, width: int) -> None:
        """Links back from the picked neighbours; full rows are pruned by the diversity rule."""
        to = picked.ravel()
        frm = np.repeat(fresh, picked.shape[1])
        keep = (to >= 0) & ~(links[np.maximum(to, 0)] == frm[:, None]).any(axis=1)  # no link twice
        to, frm = to[keep], frm[keep]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        heads, first, count = np.unique(to, return_index=True, return_counts=True)
        free = (links[heads] < 0).sum(axis=1)
        rank = np.arange(len(to)) - np.repeat(first, count)
        # rows with room take the new links as they are
        roomy = np.repeat(count <= free, count)
        at = np.repeat(width - free, count) + rank
        links[to[roomy], at[roomy]] = frm[roomy]
        # the others choose again among old and new links
        full = np.flatnonzero(count > free)
        if len(full):
            most = int(count[full].max())
            for a in range(0, len(full), 2048):
                part = full[a : a + 2048]
                cand = np.full((len(part), width + most), -1, np.int64)
                cand[:, :width] = links[heads[part]]
                lens = count[part]
                rows = np.repeat(np.arange(len(part)), lens)
                cols = width + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                src = np.repeat(first[part], lens) + (cols - width)
                cand[rows, cols] = frm[src]
                if cand.shape[1] > 4 * width:  # keep the nearest; the rule rarely reaches further
                    s = np.where(cand >= 0, np.einsum("ij,ikj->ik", x[heads[part]], x[np.maximum(cand, 0)]), -2)
                    best = np.argpartition(-s, 4 * width, axis=1)[:, : 4 * width]
                    cand = np.take_along_axis(cand, best, 1)
                s = np.where(cand >= 0, np.einsum("ij,ikj->ik", x[heads[part]], x[np.maximum(cand, 0)]), -2).astype(np.float32)
                chosen = diverse(x, cand, s, width, fill=True)
                row = np.full((len(part), width), -1, np.int32)
                row[:, : chosen.shape[1]] = chosen
                links[heads[part]] = row

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k best rows per query, -1 where there are fewer."""
        if not len(self.x):
            return np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2.0, np.float32)
        at = np.zeros((len(q), 1), np.int64)  # position 0 belongs to every level
        for lv in range(len(self.levels) - 1, 0, -1):
            members, links = self.levels[lv]
            found, _ = beam_search(self.x[members], links, q, at, 4, len(members))
            at = found[:, :1]  # members of a level are a prefix of those of the level below
        members, links = self.levels[0]
        start = at
        found, sims = beam_search(self.x[members], links, q, start, max(beam, k), len(members))
        rows = np.where(found >= 0, members[np.maximum(found, 0)], -1)
        return rows[:, :k], sims[:, :k]

    def to_bytes(self) -> dict[str, bytes]:
        return {"x": self.x.tobytes(), "sizes": np.array([len(m) for m, _ in self.levels], np.int32).tobytes(), "members": self.levels[0][0].astype(np.int32).tobytes(), "links": b"".join(np.ascontiguousarray(ln, np.int32).tobytes() for _, ln in self.levels)}

    @classmethod
    def from_bytes(cls, dim: int, parts: dict[str, bytes], links: int = LINKS) -> Graph:
        g = cls.__new__(cls)
        g.links = links
        g.x = np.frombuffer(parts["x"], np.float32).reshape(-1, dim)
        sizes = np.frombuffer(parts["sizes"], np.int32)
        members = np.frombuffer(parts["members"], np.int32)
        flat, at, g.levels = np.frombuffer(parts["links"], np.int32), 0, []
        for lv, size in enumerate(sizes):
            width = links * 2 if lv == 0 else links
            g.levels.append((members[:size], flat[at : at + size * width].reshape(size, width)))
            at += size * width
        return g


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries side by side; (rows, similarities), best first, -1 and -2 where there are fewer.

    Each round expands the best open row of every query that still has one. ``limit``: rows below it are in the graph.
    """
    m = len(q)
    found = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -2.0, np.float32)
    for a in range(0, m, BEAM_BLOCK):
        part = slice(a, a + BEAM_BLOCK)
        found[part], sims[part] = _beam_block(x, links, q[part], start[part], beam, limit)
    return found, sims


def _beam_block(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    m, width = len(q), links.shape[1]
    seen = np.zeros((m, limit), bool)
    found = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -2.0, np.float32)
    opened = np.ones((m, beam), bool)
    first = start[:, 0]
    found[:, 0] = first
    sims[:, 0] = np.einsum("ij,ij->i", q, x[first])
    opened[:, 0] = False
    rows = np.arange(m)
    seen[rows, first] = True
    live = rows
    while len(live):
        open_sims = np.where(opened[live] | (found[live] < 0), -3.0, sims[live])
        pick = np.argmax(open_sims, axis=1)
        has = open_sims[np.arange(len(live)), pick] > -3
        live, pick = live[has], pick[has]
        if not len(live):
            break
        opened[live, pick] = True
        nxt = links[found[live, pick]].astype(np.int64)
        valid = (nxt >= 0) & (nxt < limit)
        safe = np.where(valid, nxt, 0)
        new = valid & ~seen[live[:, None], safe]
        r, c = np.nonzero(new)
        if not len(r):
            continue
        seen[live[r], safe[r, c]] = True
        s = np.full((len(live), width), -2.0, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[live[r]], x[safe[r, c]])
        all_s = np.hstack([sims[live], s])
        all_f = np.hstack([found[live], np.where(new, nxt, -1)])
        all_o = np.hstack([opened[live], ~new])
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_s, top, 1)
        found[live] = np.take_along_axis(all_f, top, 1)
        opened[live] = np.take_along_axis(all_o, top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, k: int, fill: bool = True) -> np.ndarray:
    """Up to k of each row's candidates: nearest first, one that is nearer to a chosen one than to the row itself is put
    off; free places go to those put off, nearest first."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * k]
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    m, c = cand.shape
    out = np.full((m, k), -1, np.int64)
    count = np.zeros(m, int)
    taken = np.zeros((m, c), bool)
    for j in range(c):
        v = cand[:, j]
        ok = (v >= 0) & (count < k)
        if j:
            ok &= v != cand[:, j - 1]
        rows = np.flatnonzero(ok)
        if not len(rows):
            continue
        near = np.einsum("ij,ikj->ik", x[v[rows]], x[np.maximum(out[rows], 0)])
        near[out[rows] < 0] = -2
        same = (out[rows] == v[rows, None]).any(axis=1)
        good = (near.max(axis=1) <= sims[rows, j]) & ~same
        taken[rows[same], j] = True
        rows = rows[good]
        out[rows, count[rows]] = v[rows]
        count[rows] += 1
        taken[rows, j] = True
    if fill:
        for j in range(c):
            rows = np.flatnonzero((cand[:, j] >= 0) & (count < k) & ~taken[:, j])
            if len(rows):
                rows = rows[~(out[rows] == cand[rows, j][:, None]).any(axis=1)]
                out[rows, count[rows]] = cand[rows, j]
                count[rows] += 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar(vectors: DataFrame, stores: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, probes: int = PROBES) -> DataFrame:
    """``id``, ``other``, ``cosine`` (6 decimals), ``place`` (1..k): the k most similar symbols of each usable vector.

    Equal cosines are ordered by the smaller id; a symbol is never its own neighbour. Vectors of different dimension are
    never compared. A dimension with one vector gives no rows. All different vectors of a symbol take part; its list has
    every other symbol once, with the best cosine between any of their vectors. Nulls, NaN, wrong lengths and zero vectors
    are left out; exact repeats count once; an empty table gives an empty result.

    Nodes are distinct vectors, so a vector shared by a third of all rows is one node; of its ids the smallest k + 1 stand
    for it as neighbours. Its list is computed once and spread over its ids.
    """
    ok = usable(vectors, stores).withColumn("node", F.xxhash64("dim", "embedding"))
    members = materialize(ok.select("dim", "node", F.col("symbol_id").alias("id")).distinct(), "members")
    top = Window.partitionBy("dim", "node").orderBy("id")
    # the row limit is pushed below the shuffle, so a hot node sends k + 1 rows per task
    few = members.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + _SPARE)
    faces = few.groupBy("dim", "node").agg(F.array_sort(F.collect_list("id")).alias("faces"))
    nodes = ok.groupBy("dim", "node").agg(F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.join(faces, ["dim", "node"]), "nodes")
    placed = materialize(_placed(nodes, shard_rows, probes), "placed")
    asked = placed.select("dim", F.posexplode("cells").alias("at", "cell"))
    cells = asked.groupBy("dim", "cell").agg(F.sum((F.col("at") == 0).cast("long")).alias("n"), F.count(F.lit(1)).alias("asks"))
    # one row per cell with nodes, at most MAX_PIVOTS per dimension
    cells = cells.where("n > 0").select("dim", "cell", F.ceil(F.col("n") / F.lit(2 * shard_rows)).cast("int").alias("subs"), F.ceil(F.col("asks") / F.lit(QUERY_BLOCK_ROWS)).cast("int").alias("blocks"))
    cells = materialize(cells, "cells")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
        g = Graph(_unit(raw).astype(np.float32)).to_bytes()
        sizes = pdf["faces"].map(len).to_numpy(np.int32)
        return pd.DataFrame([{"dim": key[0], "cell": key[1], "sub": key[2], "nodes": pdf["node"].to_numpy(np.int64).tobytes(), "faces": np.concatenate(pdf["faces"].to_numpy()).astype(np.int64).tobytes(), "n_faces": sizes.tobytes(), **g, "x": raw.tobytes()}])

    home = placed.withColumn("cell", F.col("cells")[0]).join(F.broadcast(cells), ["dim", "cell"]).withColumn("sub", F.pmod("node", "subs").cast("int"))
    graphs = home.select("dim", "cell", "sub", "node", "embedding", "faces").groupBy("dim", "cell", "sub").applyInPandas(
        build, "dim int, cell int, sub int, nodes binary, faces binary, n_faces binary, x binary, sizes binary, members binary, links binary"
    )
    graphs = materialize(graphs, "graphs")
    # a block of the queries of a cell meets one copy of its graph: both sides grow in proportion to the nodes
    queries = placed.select("dim", "node", "embedding", F.explode("cells").alias("cell")).join(F.broadcast(cells), ["dim", "cell"])
    queries = queries.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", "embedding")
    copies = graphs.join(F.broadcast(cells), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("subs", "blocks")

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"dim": [], "node": [], "best": []})
        r = right.iloc[0]
        g = Graph.from_bytes(int(r["dim"]), {c: r[c] for c in ("x", "sizes", "members", "links")})
        unit = _unit(g.x)
        g.x = unit.astype(np.float32)
        sizes = np.frombuffer(r["n_faces"], np.int32)
        best = []
        for a in range(0, len(left), 4096):  # bounds the arrays of found rows
            q = _unit(np.stack(left["embedding"].iloc[a : a + 4096].to_numpy()))
            rows, _ = g.search(q.astype(np.float32), k + _SPARE + 2, beam)
            best += nearest(q, unit, rows, np.frombuffer(r["faces"], np.int64), sizes, k + _SPARE)
        return pd.DataFrame({"dim": left["dim"].to_numpy(), "node": left["node"].to_numpy(np.int64), "best": best})

    keys = ["dim", "cell", "sub", "block"]
    near = queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(look_up, f"dim int, node long, best {_BEST}")
    lists = near.groupBy("dim", "node").agg(_once(F.flatten(F.collect_list("best")), k + _SPARE).alias("best"))
    # k + 1 ids per node are enough for every id of the node: at most one of them is the asking id itself
    mine = members.join(lists, ["dim", "node"]).groupBy("dim", "id").agg(F.flatten(F.collect_list("best")).alias("best"))
    mine = mine.select("id", F.posexplode(_once(F.filter("best", lambda x: x["other"] != F.col("id")), k)).alias("p", "x"))
    return mine.select("id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("cosine"), (F.col("p") + 1).alias("place"))


_BEST = "array<struct<d: double, other: bigint>>"


def _placed(nodes: DataFrame, shard_rows: int, probes: int) -> DataFrame:
    """``nodes`` with ``cells``: the numbers of the nearest cells, the node's own first.

    Pivots are the nodes with the smallest hashes; the driver and the tasks hold at most MAX_PIVOTS of a dimension.
    """
    spark = nodes.sparkSession
    pivots: dict[int, np.ndarray] = {}
    for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per dimension
        want = min(MAX_PIVOTS, -(-int(r.n) // shard_rows))
        if want > 1:
            few = nodes.where(F.col("dim") == int(r.dim)).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(want).select("embedding").toPandas()
            pivots[int(r.dim)] = _unit(np.stack(few["embedding"].to_numpy())).astype(np.float32)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        for pdf in batches:
            cells = np.empty(len(pdf), object)
            for dim in pdf["dim"].unique():
                here, p = np.flatnonzero(pdf["dim"].to_numpy() == dim), shared.value.get(int(dim))
                if p is None:
                    for i in here:
                        cells[i] = [0]
                    continue
                n = min(probes, len(p))
                for a in range(0, len(here), 1024):
                    part = here[a : a + 1024]
                    sims = _unit(np.stack(pdf["embedding"].iloc[part].to_numpy())).astype(np.float32) @ p.T
                    far = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < len(p) else np.tile(np.arange(n), (len(part), 1))
                    order = np.argsort(-np.take_along_axis(sims, far, 1), axis=1, kind="stable")
                    for i, row in zip(part, np.take_along_axis(far, order, 1)):
                        cells[i] = row
            yield pdf.assign(cells=list(cells))

    return nodes.mapInPandas(place, "dim int, node long, embedding array<float>, faces array<long>, cells array<int>")


def nearest(q: np.ndarray, x: np.ndarray, rows: np.ndarray, faces: np.ndarray, sizes: np.ndarray, k: int) -> list[list[dict]]:
    """Per query the ``k`` best ids behind the rows that were found: [{d: minus the cosine, other: id}], best first, each id
    once. ``sizes`` has the number of each row's ids, which stand one after the other in ``faces``."""
    ends = np.cumsum(sizes)
    at, col = np.nonzero(rows >= 0)
    row = rows[at, col]
    d = -np.round(np.einsum("ij,ij->i", q[at], x[row]), 6)
    n = sizes[row]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    other = faces[np.repeat(ends[row] - n, n) + inner]
    at, d = np.repeat(at, n), np.repeat(d, n)
    order = np.lexsort((d, other, at))
    at, d, other = at[order], d[order], other[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (other[1:] != other[:-1])
    at, d, other = at[first], d[first], other[first]
    order = np.lexsort((other, d, at))
    at, d, other = at[order], d[order], other[order]
    starts = np.searchsorted(at, np.arange(len(q)))
    stops = np.minimum(np.searchsorted(at, np.arange(len(q)), "right"), starts + k)
    return [[{"d": a, "other": b} for a, b in zip(d[s:e].tolist(), other[s:e].tolist())] for s, e in zip(starts, stops)]


def _once(best, n: int):
    """The ``n`` first of a list of (d, other) in order, each ``other`` once."""
    ordered = F.array_sort(best)
    return F.slice(F.filter(ordered, lambda x, i: (i == 0) | ~F.exists(F.slice(ordered, 1, i), lambda y: y["other"] == x["other"])), 1, n)


def recall(found: DataFrame, vectors: DataFrame, stores: DataFrame, k: int = 5, one_in: int = 50) -> DataFrame:
    """``n_expected``, ``n_found``, ``recall`` of ``found`` against the exact lists of every id divisible by ``one_in``.

    The queries are compared with all vectors in blocks of rows; each task keeps k per query only.
    """
    ok = materialize(usable(vectors, stores).distinct(), "truth")
    q = ok.where(F.col("symbol_id") % one_in == 0).select("dim", F.col("symbol_id").alias("id"), "embedding")
    n_blocks = max(1, -(-q.count() // 8192))
    n_parts = max(8, -(-ok.count() // 65_536))
    asks = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    rows = ok.withColumn("part", F.pmod(F.xxhash64("symbol_id"), F.lit(n_parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def brute(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "c": []})
        b, ids = _unit(np.stack(right["embedding"].to_numpy())), right["symbol_id"].to_numpy(np.int64)
        n = np.arange(len(ids), dtype=np.int32)
        out = []
        for a in range(0, len(left), 256):
            some = left.iloc[a : a + 256]
            sims = np.round(_unit(np.stack(some["embedding"].to_numpy())) @ b.T, 6)
            for i, c in zip(some["id"].to_numpy(np.int64), sims):
                best = nearest(np.ones((1, 1)), c[:, None], n[None, c >= np.partition(c, -min(8 * k, len(c)))[-min(8 * k, len(c))]], ids, np.ones(len(ids), np.int32), k + 1)[0]
                out += [(i, x["other"], -x["d"]) for x in best if x["other"] != i][:k]
        return pd.DataFrame(out, columns=["id", "other", "c"])

    keys = ["dim", "block", "part"]
    parts = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(brute, "id long, other long, c double")
    w = Window.partitionBy("id").orderBy(F.desc("c"), F.asc("other"))
    truth = parts.groupBy("id", "other").agg(F.max("c").alias("c")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id", "other")
    hits = truth.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def within(found: DataFrame, least: float) -> DataFrame:
    """``id_a`` < ``id_b``: the pairs of ``found`` with at least this cosine, each once."""
    return found.where(F.col("cosine") >= least).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

