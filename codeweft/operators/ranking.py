"""Candidates, fusion, reranking and selection (R4-R21). The working table is ``query_id``, ``id``, ``rank`` or ``score``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import anchors as A
from codeweft.functions.text import CALLABLE, TYPE_DEFS, expand_seed, is_test_path, is_utility, pivot_eligible, query_terms
from codeweft.operators import blocks
from codeweft.plans.materialize import if_small, materialize

#: Rank constants of the fusion, per retriever.
FUSION_K = {"bm25": 60, "graph": 60, "semantic": 60, "anchor": 15, "traceback": 8, "reverse": 30}
GRAPH_POOL, ANCHOR_POOL, ANCHOR_ROWS, PROBE, PROBE_MOST, SEMANTIC_POOL = 25, 20, 5, 20, 3, 25
REVERSE_DEPTH, REVERSE_FAN, REVERSE_MOST, REVERSE_CALLERS = 3, 5, 20, 500
PIVOTS, ADJACENT, ADJACENT_PER_FILE, PINNED = 8, 20, 2, 5


def ranked_by(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    return ranked_by(df, by, order, name).where(F.col(name) <= limit)


def graph_candidates(link: DataFrame, seeds: DataFrame, cent: DataFrame, limit: int = GRAPH_POOL) -> DataFrame:
    """Neighbours in both directions of the seeds (``query_id``, ``id``) that are no seeds, by centrality.

    Of a node's neighbours only the best ``limit`` and as many as a query has seeds can come out, so the lists of hubs are
    cut to these before they meet the queries.
    """
    most = seeds.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    both = link.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(link.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    ranked = both.distinct().join(cent.select(F.col("id").alias("other"), F.round("centrality", 6).alias("centrality")), "other")
    best = top(ranked, ["id"], [F.desc("centrality"), F.asc("other")], limit + most, "r")
    near = seeds.select("query_id", "id").distinct().join(best, "id").select("query_id", F.col("other").alias("id"), "centrality").distinct()
    near = near.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return top(near, ["query_id"], [F.desc("centrality"), F.asc("id")], limit).select("query_id", "id", "rank")


def anchor_candidates(symbols: DataFrame, queries: DataFrame, names_found: DataFrame | None = None, limit: int = ANCHOR_POOL) -> DataFrame:
    """``query_id``, ``id``, ``rank``: symbols that a task names. Per name up to five symbols with that leaf; only names without
    any fall back to a search in names, which counts if it has at most three hits. First position wins."""
    from codeweft.operators.bm25 import search_name

    names = queries.select("query_id", F.posexplode(A.anchors(F.col("task"))).alias("pos", "name"))
    names = names.withColumn("leaf", F.element_at(F.split("name", r"\."), -1))
    hit = names.join(symbols.select("id", F.col("leaf_name").alias("leaf"), F.size(F.split("fqn", "::")).alias("depth")), "leaf")
    exact = hit.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy(F.when(F.col("name").contains("."), F.col("depth")).otherwise(0), "id"))).where(F.col("r") <= ANCHOR_ROWS)
    rest = names.join(exact.select("query_id", "pos").distinct(), ["query_id", "pos"], "left_anti")
    probe = search_name(symbols, rest.select(F.struct("query_id", "pos").alias("query_id"), F.col("leaf").alias("task")), PROBE)
    few = probe.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where(F.col("n") <= PROBE_MOST)
    fall = few.select("query_id.query_id", "query_id.pos", "id", F.col("rank").alias("r"))
    both = exact.select("query_id", "pos", "id", "r").unionByName(fall)
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("pos", "r")).alias("p"))
    return top(first, ["query_id"], [F.asc("p"), F.asc("id")], limit).select("query_id", "id", "rank")


def traceback_candidates(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols of the functions in a task's traceback whose file ends with the frame's path, in frame order."""
    f = queries.select("query_id", F.posexplode(A.frames(F.col("task"))).alias("pos", "f")).select("query_id", "pos", F.col("f.path").alias("path"), F.element_at(F.split("f.function", r"\."), -1).alias("leaf_name"))
    hit = f.join(symbols.select("id", "leaf_name", "file_path"), "leaf_name").where(F.col("file_path").endswith(F.col("path")))
    first = hit.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return ranked_by(first, ["query_id"], [F.asc("pos"), F.asc("id")]).select("query_id", "id", "rank")


def reverse_expand(link: DataFrame, symbols: DataFrame, cent: DataFrame, anchors: DataFrame, queries: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``id``, ``rank``, ``score``: callers up to three steps above the exception types that are anchors.

    Per reached symbol the five best unvisited callers by words in common with the task, similarity and low centrality; at most 20 in
    all, in the order in which they are reached. Exception types with more than 500 callers are not followed.
    """
    flags = symbols.select("id", F.lower("name").alias("ln"), F.lower("fqn").alias("lf"), "is_stub", "kind", expand_seed(F.col("kind"), F.col("name"), F.col("is_stub")).alias("seed"))
    busy = link.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REVERSE_CALLERS).select("id")
    seeds = anchors.select("query_id", "id", "rank").join(flags.where("seed").select("id"), "id", "left_semi").join(busy, "id", "left_anti")
    words = queries.select("query_id", query_terms(F.col("task")).alias("words"))
    callers = link.select(F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    usable = flags.where("NOT is_stub AND kind <> 'import'").select(F.col("id").alias("next"), "ln", "lf")
    front = materialize(seeds.select("query_id", "id", F.col("rank").alias("ord")), "front")
    seen = front.select("query_id", "id")
    out = front.select("query_id", "id", F.lit(0).alias("depth"), F.col("ord").cast("int").alias("ord")).where("false")
    for depth in range(REVERSE_DEPTH):
        if front.isEmpty():  # most tasks name no exception
            break
        step = callers.join(if_small(front), "id").join(usable, "next").join(words, "query_id").join(seen.select("query_id", F.col("id").alias("next")), ["query_id", "next"], "left_anti")
        step = step.join(cent.select(F.col("id").alias("next"), "centrality"), "next", "left")
        if semantic is not None:
            step = step.join(semantic.select("query_id", F.col("id").alias("next"), F.col("similarity").alias("sem")), ["query_id", "next"], "left")
        else:
            step = step.withColumn("sem", F.lit(0.0))
        overlap = F.aggregate("words", F.lit(0), lambda s, w: s + (F.col("ln").contains(w) | F.col("lf").contains(w)).cast("int"))
        gain = overlap + 2.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("sem", F.lit(0.0)))) - 0.1 * F.coalesce("centrality", F.lit(0.0))
        fan = top(step.withColumn("gain", F.round(gain, 6)), ["query_id", "id", "ord"], [F.desc("gain"), F.asc("next")], REVERSE_FAN, "r")
        first = fan.groupBy("query_id", "next").agg(F.min(F.struct("ord", "r")).alias("p"))
        front = materialize(ranked_by(first, ["query_id"], [F.asc("p"), F.asc("next")], "ord").select("query_id", F.col("next").alias("id"), "ord"), "front")
        seen = seen.unionByName(front.select("query_id", "id"))
        level = front.select("query_id", "id", F.lit(depth).alias("depth"), "ord")
        out = out.unionByName(level)
    return top(out, ["query_id"], [F.asc("depth"), F.asc("ord")], REVERSE_MOST).select("query_id", "id", "rank", (1.0 / (F.col("depth") + 2)).alias("score"))


def fuse(lists: dict[str, DataFrame], ks: dict[str, int] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of named lists (``query_id``, ``id``, ``rank`` from 1): ``query_id``, ``id``, ``score``."""
    ks = FUSION_K | (ks or {})
    parts = [df.select("query_id", "id", (1.0 / (F.lit(ks[n]) + F.col("rank"))).alias("s")) for n, df in lists.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def inject_structural(scored: DataFrame, family: DataFrame, queries: DataFrame, max_pivots: int = PIVOTS) -> DataFrame:
    """For structural tasks the types with the largest families are added with five times their family score."""
    best = family.orderBy(F.desc(F.round("family_score", 6)), "id").limit(2 * max_pivots).select("id", (5.0 * F.col("family_score")).alias("score"))
    add = queries.where("intent = 'structural'").select("query_id").crossJoin(F.broadcast(best))  # 2 x max_pivots rows
    return scored.unionByName(add.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "score"))


def proximity(scored: DataFrame, symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores times a factor from the task's words in name, signature and body, the path, kind and intent."""
    q = queries.select("query_id", "intent", F.filter(F.split(F.lower("task"), r"\s+"), lambda w: w != "").alias("words"))
    s = symbols.select("id", F.lower("name").alias("n"), F.lower(F.coalesce("signature", F.lit(""))).alias("s"), F.lower(F.coalesce("body", F.lit(""))).alias("b"), "kind", "language", "file_path")
    hit = lambda col, w, v: F.when(F.col(col).contains(w), v).otherwise(0.0)
    factor = F.aggregate("words", F.lit(1.0), lambda acc, w: acc + hit("n", w, 2.0) + hit("s", w, 1.0) + hit("b", w, 0.3))
    test = is_test_path(F.col("file_path"))
    wide = F.col("intent").isin("structural", "explore")
    factor = factor * F.when(test, 0.25).otherwise(1.0) * F.when(is_utility(F.col("file_path")), 0.3).otherwise(1.0)
    factor = factor * F.when(wide & F.col("kind").isin(*TYPE_DEFS), 2.5).when(wide & (F.col("kind") == "impl"), 1.5).when(wide & F.col("kind").isin(*CALLABLE) & ~test, 0.6).otherwise(1.0)
    factor = factor * F.when(F.col("language") == "markdown", 1.5).otherwise(1.0)
    return scored.join(q, "query_id").join(s, "id").select("query_id", "id", (F.col("score") * factor).alias("score"))


def centrality_boost(scored: DataFrame, symbols: DataFrame, cent: DataFrame) -> DataFrame:
    """Code times 1 + 3 centrality, Markdown times 2.5."""
    j = scored.join(symbols.select("id", "language"), "id", "left").join(cent.select("id", "centrality"), "id", "left")
    return j.select("query_id", "id", (F.col("score") * F.when(F.col("language") == "markdown", 2.5).otherwise(1 + 3 * F.coalesce("centrality", F.lit(0.0)))).alias("score"))


def semantic_blend(scored: DataFrame, semantic: DataFrame) -> DataFrame:
    """Half the score and half the similarity, where that is positive."""
    j = scored.join(semantic.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    return j.select("query_id", "id", F.when(F.col("similarity") > 0, 0.5 * F.col("score") + 0.5 * F.col("similarity")).otherwise(F.col("score")).alias("score"))


def structural_resort(scored: DataFrame, symbols: DataFrame, family: DataFrame, queries: DataFrame, bm25: DataFrame) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``hub``: for structural tasks types come first, by family, score and how many of the
    types in question they own (``hub`` 1 sorts before 0); other tasks keep their order (``hub`` 0)."""
    hubs = symbols.where(F.col("kind").isin(*TYPE_DEFS, "impl", "module")).select("id", "name", "body", "file_path")
    q = queries.where("intent = 'structural'").select("query_id", F.transform(F.filter(query_terms(F.col("task")), lambda w: F.length(w) > 3), lambda w: F.left(w, F.lit(4))).alias("stems"))
    own = scored.join(q, "query_id").join(hubs, "id")
    seeds = own.join(bm25.select("query_id", "id"), ["query_id", "id"], "left_semi").where((F.octet_length("name") > 4) & F.exists("stems", lambda w: F.lower("name").contains(w))).select("query_id", F.col("name").alias("seed")).distinct()
    seeds = seeds.withColumn("n_seeds", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("n_seeds >= 2").drop("n_seeds")
    body = F.coalesce("body", F.lit(""))
    names = [F.concat(F.lit(a), F.col("seed"), F.lit(b)) for a, b in ((": ", ""), (": [", "]"), ("[", "]"))]
    owns = reduce(lambda x, y: x | y, [body.contains(n) for n in names])
    # hubs and seeds are both among the candidates of one query, a few hundred at most
    owned = own.where(~is_test_path(F.col("file_path"))).join(seeds, "query_id").where((F.col("seed") != F.col("name")) & owns).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("owned"))
    j = own.join(family.select("id", "family_score"), "id", "left").join(owned, ["query_id", "id"], "left")
    value = 20 * F.coalesce("family_score", F.lit(0.0)) + 0.05 * F.col("score") + F.when(F.col("owned") >= 2, 5.0 * F.col("owned")).otherwise(0.0)
    first = j.select("query_id", "id", value.alias("score"), F.lit(1).alias("hub"))
    rest = scored.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "score", F.lit(0).alias("hub"))
    return first.unionByName(rest)


def dedup_and_penalise(scored: DataFrame, symbols: DataFrame) -> DataFrame:
    """The best row per name, stubs times 0.3; a query with a stub is sorted by score alone afterwards."""
    j = scored.join(symbols.select("id", "fqn", "is_stub"), "id", "left")
    one = top(j, ["query_id", "fqn"], [F.desc("hub"), F.desc("score"), F.asc("id")], 1, "r").drop("r")
    any_stub = F.max(F.coalesce("is_stub", F.lit(False)).cast("int")).over(Window.partitionBy("query_id"))
    hub = F.when(any_stub == 1, 0).otherwise(F.col("hub"))
    out = one.select("query_id", "id", F.when(F.col("is_stub"), F.col("score") * 0.3).otherwise(F.col("score")).alias("score"), hub.alias("hub"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hub"), F.desc(F.round("score", 6)), "id")))


def post_filter(ranked: DataFrame, symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """F1: by the query's ``language``, ``file_hint`` and ``min_score`` (null: no filter), after all ranking."""
    j = ranked.join(symbols.select("id", "language", "file_path"), "id").join(queries.select("query_id", F.col("language").alias("ql"), "file_hint", "min_score"), "query_id")
    ok = (F.col("ql").isNull() | (F.lower("language") == F.lower("ql"))) & (F.col("file_hint").isNull() | F.col("file_path").contains(F.col("file_hint"))) & (F.col("min_score").isNull() | (F.col("score") >= F.col("min_score")))
    return j.where(ok).select(*ranked.columns)


def pivots(ranked: DataFrame, symbols: DataFrame, anchors: DataFrame, reverse: DataFrame, most: int = PIVOTS) -> DataFrame:
    """``query_id``, ``place``, ``id``: one pin per file for anchors and expanded callers (at most five), then the best ranked.

    The pin of a file is its deepest, then shortest name."""
    s = symbols.select("id", "file_path", "fqn", pivot_eligible(F.col("kind"), F.col("name"), F.col("body"), F.col("is_stub")).alias("ok")).where("ok")
    order = anchors.select("query_id", "id", F.col("rank").alias("o")).unionByName(reverse.select("query_id", "id", (F.col("rank") + 1_000_000).alias("o")))
    pins = order.groupBy("query_id", "id").agg(F.min("o").alias("o")).join(s, "id")
    w = Window.partitionBy("query_id", "file_path")
    pins = pins.withColumn("fo", F.min("o").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.size(F.split("fqn", "::"))), F.length("fqn"), "id"))).where("r = 1")
    pins = top(pins, ["query_id"], [F.asc("fo"), F.asc("id")], min(PINNED, most), "p").select("query_id", "id", F.col("p").cast("long").alias("o"))
    fill = ranked.join(s.select("id"), "id", "left_semi").join(pins.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", (F.col("rank") + 1_000_000).cast("long").alias("o"))
    return top(pins.unionByName(fill), ["query_id"], [F.asc("o"), F.asc("id")], most, "place").select("query_id", "place", "id")


def adjacents(chosen: DataFrame, link: DataFrame, symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id``, ``place``, ``id``: neighbours of the pivots by intent (debug: callees; refactor: callers; else callees, then
    callers), 20 before repeats are dropped, no tests for structural and explore, at most two per file."""
    q = queries.select("query_id", "intent")
    out = link.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(0).alias("d"))
    inn = link.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit(1).alias("d"))
    near = chosen.join(q, "query_id").join(out.unionByName(inn), "id")
    near = near.where(((F.col("intent") == "debug") & (F.col("d") == 0)) | ((F.col("intent") == "refactor") & (F.col("d") == 1)) | ~F.col("intent").isin("debug", "refactor"))
    near = near.join(chosen.select("query_id", F.col("id").alias("other")), ["query_id", "other"], "left_anti")
    first = top(near, ["query_id"], [F.asc("place"), F.asc("d"), F.asc("other")], ADJACENT, "pos").groupBy("query_id", "intent", F.col("other").alias("id")).agg(F.min("pos").alias("pos"))
    j = first.join(symbols.select("id", "file_path"), "id").where(~(F.col("intent").isin("structural", "explore") & is_test_path(F.col("file_path"))))
    kept = top(j, ["query_id", "file_path"], [F.asc("pos")], ADJACENT_PER_FILE, "r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).select("query_id", "place", "id")


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int = SEMANTIC_POOL) -> DataFrame:
    """``query_id``, ``id``, ``rank``, ``similarity``: the exact best k vectors (``id``, ``embedding``) per query vector.

    Query vectors are those of a batch of tasks; they meet all vectors of their length in
    blocks, and each task keeps k per query. Of several vectors of an id the nearest counts."""
    hits = blocks.nearest(vectors, queries, k)
    return top(hits, ["query_id", "size"], [F.desc("similarity"), F.asc("id")], k).select("query_id", "id", "rank", "similarity")
