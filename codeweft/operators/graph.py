"""Dependency graph operators (E7, G1-G12): edge and node tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import TYPE_DEFS, is_test_file
from codeweft.plans.materialize import if_small, materialize
from codeweft.sources.tables import edge_kind

#: The edge kinds in the order in which extractors are run; other kinds count as references.
KIND_ORDER = {"imports": 1, "implements": 2, "calls": 3, "references": 4, "inherits": 5, "defined_in": 6}


#: Names that a search for suggestions compares with all symbols at once.
MOST_TYPED = 10_000


def known_kind(kind: Column) -> Column:
    """Normal form of an edge kind; unknown and null kinds are references."""
    k = edge_kind(kind)
    return F.when(k.isin(*KIND_ORDER), k).otherwise(F.lit("references"))


def links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``from_id``, ``to_id``, ``kind``: one edge per ordered pair of existing nodes, the first kind wins. No self-links."""
    order = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    e = edges.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id"))).select("from_id", "to_id", known_kind(F.col("kind")).alias("kind"))
    one = e.groupBy("from_id", "to_id").agg(F.min_by("kind", order[F.col("kind")]).alias("kind"))  # combined before the joins
    ids = nodes.select("id")
    return one.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "kind")


def degrees(link: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``n_in``, ``n_out``, ``raw`` (2 in + out) of every node, 0 for isolated ones."""
    ins = link.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    outs = link.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    d = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["n_in", "n_out"])
    return d.withColumn("raw", 2 * F.col("n_in") + F.col("n_out"))


def half_point(deg: DataFrame, p: float = 0.5, override: float | None = None) -> DataFrame:
    """One row ``k``: the raw degree at position round((n - 1) p) of the sorted degrees, at least 1; 15 for no nodes.

    Counted over a histogram of degrees, so no sort of all nodes is needed.
    """
    if override is not None:
        return deg.sparkSession.range(1).select(F.lit(max(1.0, float(override))).alias("k"))
    hist = deg.groupBy("raw").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct degree
    cum = hist.withColumn("upto", F.sum("c").over(w)).crossJoin(F.broadcast(hist.agg(F.sum("c").alias("n"))))
    at = F.floor((F.col("n") - 1) * F.lit(min(1.0, max(0.0, p))) + 0.5)
    return cum.where(F.col("upto") > at).agg(F.min("raw").alias("raw")).select(F.when(F.col("raw").isNull(), 15).otherwise(F.greatest(F.col("raw"), F.lit(1))).cast("double").alias("k"))


def centrality(deg: DataFrame, p: float = 0.5, override: float | None = None) -> DataFrame:
    """``deg`` with ``centrality`` = raw / (raw + k)."""
    return deg.crossJoin(F.broadcast(half_point(deg, p, override))).withColumn("centrality", F.col("raw") / (F.col("raw") + F.col("k"))).drop("k")


def family(deg: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``total``, ``family_score`` of type definitions and modules: own in-degree and that of all symbols whose name
    begins with ``<name>::``. Names are matched by exploding their proper prefixes, not by a prefix join."""
    d = deg.join(nodes.select("id", "name", "kind"), "id")
    parts = F.split("name", "::")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"))
    heirs = d.where((F.size(parts) > 1) & (F.col("n_in") > 0)).select(F.explode(pre).alias("name"), "n_in").groupBy("name").agg(F.sum("n_in").alias("heirs"))
    types = d.where(F.col("kind").isin(*TYPE_DEFS, "module")).select("id", "name", "n_in")
    out = types.join(heirs, "name", "left").select("id", (F.col("n_in") + F.coalesce("heirs", F.lit(0))).alias("total"))
    return out.withColumn("family_score", F.col("total") / (F.col("total") + 5.0))


def neighbours(link: DataFrame) -> DataFrame:
    """G1: ``id``, ``other``, ``direction`` (in: callers, out: callees)."""
    ins = link.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit("in").alias("direction"))
    return ins.unionByName(link.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit("out").alias("direction")))


def blast_radius(link: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """``seed``, ``id``, ``depth``: what depends on the seeds, nearest first, 1 <= depth <= max_depth - 1.

    A frontier per round, joined on the target; visited pairs are left out. Each round is written to the shared folder, so
    the plan does not grow with the depth. A frontier of bounded size goes to the links, so the links of a target that draws
    most of them stay where they are.
    """
    back = link.select(F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    front = materialize(seeds.select(F.col("id").alias("seed"), "id").distinct(), "front")
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth):
        step = back.join(if_small(front), "id").select("seed", F.col("next").alias("id")).distinct()
        front = materialize(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def impact(link: DataFrame, nodes: DataFrame, cent: DataFrame, seeds: DataFrame, max_depth: int = 5, max_results: int = 100, include_tests: bool = True) -> DataFrame:
    """``seed``, ``relation`` (direct, transitive), ``place``, ``id``, ``fqn``, ``total_affected``, ``truncated``.

    Direct callers are part of both lists; ``total_affected`` counts both before the caps.
    """
    blast = blast_radius(link, seeds, max_depth)
    direct = seeds.select(F.col("id").alias("seed")).distinct().join(link.select(F.col("to_id").alias("seed"), F.col("from_id").alias("id")), "seed")
    rows = direct.withColumn("relation", F.lit("direct")).unionByName(blast.select("seed", "id").withColumn("relation", F.lit("transitive")))
    full = rows.join(nodes.select("id", "fqn", "file_path"), "id").join(cent.select("id", "centrality"), "id")
    if not include_tests:
        full = full.where(~is_test_file(F.col("file_path")))
    w = Window.partitionBy("seed", "relation").orderBy(F.desc(F.floor(F.col("centrality") * 1e6)), "fqn", "id")
    counts = full.groupBy("seed", "relation").agg(F.count(F.lit(1)).alias("n_list"))
    totals = counts.groupBy("seed").agg(F.sum("n_list").alias("total_affected"))
    top = full.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, max_results))
    return top.join(counts, ["seed", "relation"]).join(totals, "seed").select("seed", "relation", "place", "id", "fqn", "total_affected", F.greatest(F.col("n_list") - max(1, max_results), F.lit(0)).alias("truncated"))


def shortest_paths(link: DataFrame, pairs: DataFrame) -> DataFrame:
    """``from_id``, ``to_id``, ``path`` (ids, both ends included): a shortest directed path of each pair.

    Of several, the one through the smallest ids wins. A node reaches itself by the path of one. Pairs without a path are
    absent. Parents are kept per (start, node); paths are read back from the end. A start goes on until all its ends are
    reached or nothing new is, however long its paths are.
    """
    want = pairs.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()
    front = want.select(F.col("from_id").alias("start"), F.col("from_id").alias("id")).distinct()
    seen = front.select("start", "id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))
    rank = front.withColumn("ord", F.lit(1))
    left = materialize(want.where("from_id <> to_id"), "left")
    depth = 0
    while not left.isEmpty():
        depth += 1
        step = rank.join(left.select(F.col("from_id").alias("start")), "start", "left_semi").join(link.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")), "id")
        best = step.groupBy("start", "next").agg(F.min_by(F.col("id"), F.struct("ord", "id")).alias("parent"), F.min("ord").alias("po"))
        new = best.join(seen.select("start", F.col("id").alias("next")), ["start", "next"], "left_anti")
        new = new.withColumn("ord", F.row_number().over(Window.partitionBy("start").orderBy("po", "next")))
        new = materialize(new, "bfs")
        if new.isEmpty():
            break
        left = materialize(left.join(new.select(F.col("start").alias("from_id"), F.col("next").alias("to_id")), ["from_id", "to_id"], "left_anti"), "left")
        seen = seen.unionByName(new.select("start", F.col("next").alias("id"), "parent", F.lit(depth).alias("depth")))
        rank = new.select("start", F.col("next").alias("id"), "ord")
    seen = materialize(seen, "parents")
    walk = want.join(seen.select(F.col("start").alias("from_id"), F.col("id").alias("to_id"), "parent", "depth"), ["from_id", "to_id"])
    longest = walk.agg(F.max("depth")).first()[0] or 0
    paths = walk.select("from_id", "to_id", F.array("to_id").alias("path"), F.col("parent").alias("at"))
    for _ in range(longest):
        up = seen.select(F.col("start").alias("s2"), F.col("id").alias("i2"), F.col("parent").alias("p2"))
        paths = paths.join(up, (F.col("from_id") == F.col("s2")) & (F.col("at") == F.col("i2")), "left").select("from_id", "to_id", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"), F.col("p2").alias("at"))
    return paths.select("from_id", "to_id", "path")


def suggestions(nodes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """``query``, ``place``, ``fqn``, ``score``: symbols whose name (2) or fqn (1) contains the query, any case.

    ``queries`` are typed names, MOST_TYPED at most (more raise an error); each is compared with all symbols, and every task keeps
    its best per query only.
    """
    q = queries.select("query").where("query IS NOT NULL AND query <> ''").distinct()
    if q.limit(MOST_TYPED + 1).count() > MOST_TYPED:
        raise ValueError(f"more than {MOST_TYPED} names")
    q = F.broadcast(q)
    low = F.lower("query")
    score = F.when(F.lower("name").contains(low), 2).when(F.lower("fqn").contains(low), 1)
    hits = nodes.select("name", "fqn").distinct().join(q, F.lower("fqn").contains(low) | F.lower("name").contains(low)).withColumn("score", score)
    best = hits.groupBy("query", "fqn").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "fqn")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "place", "fqn", "score")
