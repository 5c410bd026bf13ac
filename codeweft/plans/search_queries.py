"""Queries of search and ranking: the logged tasks against all symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions import anchors as A
from codeweft.operators import bm25, graph, ranking
from codeweft.plans import pipeline
from codeweft.plans.materialize import materialize
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources.tables import nodes, query_log, symbols, table


def tasks(spark, sf_dir):
    """Every distinct logged task, under the smallest id that logged it."""
    q = query_log(spark, sf_dir).where("task IS NOT NULL").groupBy("task").agg(F.min("id").alias("query_id"))
    return q.select("query_id", "task")


_TASKS = "tasks AS (SELECT min(id) AS query_id, task FROM qlog WHERE task IS NOT NULL GROUP BY task)"
_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40)"
_POST = "toks AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {_TERMS.format(f)} AS t FROM sym" for f in bm25.FIELDS) + ")"
_BM25 = f"""{_TASKS}, qt AS (SELECT DISTINCT query_id, unnest({_TERMS.format('task')}) AS term FROM tasks), {_POST},
    stats AS (SELECT field, avg(len(t)) AS avgdl FROM toks WHERE len(t) > 0 GROUP BY 1), nd AS (SELECT count(*) AS n_docs FROM sym),
    post AS (SELECT field, id, dl, term, count(*) AS tf FROM (SELECT field, id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
    dfr AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
    pw AS (SELECT id, term, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM post JOIN dfr USING (field, term) JOIN stats USING (field), nd GROUP BY 1, 2),
    bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(w), 6) AS score FROM pw JOIN qt USING (term) GROUP BY 1, 2))"""


@CORE.add("r02_bm25", with_views(f"WITH {_BM25} SELECT query_id, id, rank, score FROM bm WHERE rank <= 50"))
def r02_bm25(spark, sf_dir):
    return bm25.search(symbols(spark, sf_dir), tasks(spark, sf_dir))


@CORE.add("r03_name_search")
def r03_name_search(spark, sf_dir):
    """Names that hold all words of an anchor of a logged task side by side."""
    names = tasks(spark, sf_dir).select("query_id", F.posexplode(A.anchors(F.col("task"))).alias("pos", "name"))
    q = names.select(F.concat_ws("/", F.col("query_id").cast("string"), F.col("pos").cast("string")).alias("query_id"), F.element_at(F.split("name", r"\."), -1).alias("task"))
    return bm25.search_name(symbols(spark, sf_dir), q)


_CAND = f"""{_BM25}, hit AS (SELECT * FROM bm WHERE rank <= 50), two AS (SELECT from_id AS id, to_id AS other FROM link UNION ALL SELECT to_id, from_id FROM link),
    gc AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(centrality, 6) DESC, id) AS rank FROM (SELECT DISTINCT h.query_id, t.other AS id FROM hit h JOIN two t ON t.id = h.id
        WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.query_id = h.query_id AND x.id = t.other)) JOIN cent USING (id))"""


def _searched(spark, sf_dir):
    n = nodes(spark, sf_dir)
    s = materialize(symbols(spark, sf_dir), "symbols")
    link = materialize(graph.links(table(spark, sf_dir, "edges"), n), "link")
    cent = materialize(graph.centrality(graph.degrees(link, n)), "cent")
    hits = materialize(bm25.search(s, tasks(spark, sf_dir)), "hits")
    return s, link, cent, hits


@CORE.add("r04_graph_candidates", with_views(f"WITH {_CAND} SELECT query_id, id, rank FROM gc WHERE rank <= 25"))
def r04_graph_candidates(spark, sf_dir):
    _, link, cent, hits = _searched(spark, sf_dir)
    return ranking.graph_candidates(link, hits, cent)


_FUSED = f"{_CAND}, fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM hit UNION ALL SELECT query_id, id, rank FROM gc WHERE rank <= 25) GROUP BY 1, 2)"


@CORE.add("r10_fusion", with_views(f"WITH {_FUSED} SELECT query_id, id, round(score, 6) AS score FROM fused"))
def r10_fusion(spark, sf_dir):
    _, link, cent, hits = _searched(spark, sf_dir)
    return ranking.fuse({"bm25": hits, "graph": ranking.graph_candidates(link, hits, cent)}).select("query_id", "id", F.round("score", 6).alias("score"))


@CORE.add("r13_centrality_boost", with_views(f"WITH {_FUSED} SELECT query_id, id, round(score * CASE WHEN language = 'markdown' THEN 2.5 ELSE 1 + 3 * coalesce(centrality, 0) END, 6) AS score FROM fused LEFT JOIN sym USING (id) LEFT JOIN cent USING (id)"))
def r13_centrality_boost(spark, sf_dir):
    s, link, cent, hits = _searched(spark, sf_dir)
    fused = ranking.fuse({"bm25": hits, "graph": ranking.graph_candidates(link, hits, cent)})
    return ranking.centrality_boost(fused, s, cent).select("query_id", "id", F.round("score", 6).alias("score"))


_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(task), '{w}')" for w in words)} THEN '{n}'" for n, words in __import__("codeweft.functions.text", fromlist=["x"]).INTENT_WORDS) + " ELSE 'general' END"
_PROX = f"""{_FUSED}, qi AS (SELECT query_id, {_INTENT} AS intent, list_filter(regexp_split_to_array(lower(task), '\\s+'), lambda w: w <> '') AS words FROM tasks),
    prox AS (SELECT f.query_id, f.id, f.score * (1.0 + list_sum(list_transform(words, lambda w: CASE WHEN contains(lower(name), w) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(signature, '')), w) THEN 1.0 ELSE 0.0 END
        + CASE WHEN contains(lower(coalesce(body, '')), w) THEN 0.3 ELSE 0.0 END))) * CASE WHEN regexp_matches(lower(file_path), 'test|spec|mock') THEN 0.25 ELSE 1.0 END
        * CASE WHEN regexp_matches(regexp_extract(file_path, '[^/]*$'), '^(check-|run-|setup|generate|gen-|build-|deploy-)') THEN 0.3 ELSE 1.0 END
        * CASE WHEN intent NOT IN ('structural', 'explore') THEN 1.0 WHEN kind IN ('class','interface','type_alias','enum','struct','trait') THEN 2.5 WHEN kind = 'impl' THEN 1.5
            WHEN kind IN ('function','async_function','method','async_method') AND NOT regexp_matches(lower(file_path), 'test|spec|mock') THEN 0.6 ELSE 1.0 END
        * CASE WHEN language = 'markdown' THEN 1.5 ELSE 1.0 END AS score FROM fused f JOIN qi USING (query_id) JOIN sym s ON s.id = f.id)"""


@CORE.add("r12_proximity", with_views(f"WITH {_PROX} SELECT query_id, id, round(score + 1e-10, 6) AS score FROM prox"))
def r12_proximity(spark, sf_dir):
    s, link, cent, hits = _searched(spark, sf_dir)
    q = pipeline.prepared(tasks(spark, sf_dir))
    fused = ranking.fuse({"bm25": hits, "graph": ranking.graph_candidates(link, hits, cent)})
    return ranking.proximity(fused, s, q).select("query_id", "id", F.round(F.col("score") + 1e-10, 6).alias("score"))


@CORE.add("x07_anchors")
def x07_anchors(spark, sf_dir):
    """Names, modules and traceback frames in the text of every document."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    t = F.col("text")
    return d.select("doc_id", A.anchors(t).alias("names"), A.module_paths(t).alias("modules"), A.frames(t).alias("frames"), A.dotted(t).alias("dotted"))


@CORE.add("x01_code_blocks", "SELECT doc_id, len(regexp_extract_all(text, '```\\w*\\n([\\s\\S]*?)```', 1)) AS n_blocks FROM documents WHERE text IS NOT NULL")
def x01_code_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(A.code_blocks(F.col("text"))).alias("n_blocks"))


def _selection(spark, sf_dir):
    ix = pipeline.Index.build(symbols(spark, sf_dir), nodes(spark, sf_dir), table(spark, sf_dir, "edges"))
    return pipeline.select(ix, tasks(spark, sf_dir))


@CORE.add("r18_pivots")
def r18_pivots(spark, sf_dir):
    """The whole ranking of every logged task: its pivots."""
    return _selection(spark, sf_dir).pivots


@CORE.add("r19_adjacents")
def r19_adjacents(spark, sf_dir):
    return _selection(spark, sf_dir).adjacents


@CORE.add("r05_anchor_candidates")
def r05_anchor_candidates(spark, sf_dir):
    return ranking.anchor_candidates(symbols(spark, sf_dir), tasks(spark, sf_dir))


@CORE.add("r06_traceback_candidates")
def r06_traceback_candidates(spark, sf_dir):
    """Symbols in the tracebacks of all documents."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("task"))
    return ranking.traceback_candidates(symbols(spark, sf_dir), d)


_E = "SELECT symbol_id, embedding FROM (SELECT DISTINCT symbol_id, store_id, embedding FROM symbol_embeddings) WHERE store_id = 0 AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@CORE.add(
    "r09_semantic_topk",
    f"""WITH v AS ({_E}) SELECT query_id, id, rank, similarity FROM (SELECT q.symbol_id AS query_id, v.symbol_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity,
    row_number() OVER (PARTITION BY q.symbol_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.symbol_id) AS rank FROM (SELECT * FROM v WHERE symbol_id % 50 = 0) q, v) WHERE rank <= 25""",
)
def r09_semantic_topk(spark, sf_dir):
    """Exact best vectors of the first store, for every id divisible by 50 as the stated queries, against all of that store."""
    e = table(spark, sf_dir, "symbol_embeddings").where("store_id = 0").where(F.size("embedding") == 96).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = e.select(F.col("symbol_id").alias("id"), "embedding").distinct()
    return ranking.semantic_topk(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"))


@CORE.add(
    "r09_semantic_topk_all",
    """WITH v AS (SELECT DISTINCT symbol_id AS id, dim, CAST(embedding AS DOUBLE[]) AS e FROM symbol_embeddings JOIN embedding_store USING (store_id) WHERE symbol_id IS NOT NULL AND len(embedding) = dim
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    c AS (SELECT q.id AS query_id, v.id, q.dim, max(round(list_dot_product(q.e, v.e), 6)) AS similarity FROM v q JOIN v ON q.dim = v.dim WHERE q.id % 50 = 0 GROUP BY 1, 2, 3)
    SELECT query_id, id, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dim ORDER BY similarity DESC, id) AS rank FROM c) WHERE rank <= 25""",
)
def r09_semantic_topk_all(spark, sf_dir):
    """Exact best vectors among the usable ones of all stores, per dimension, for every id divisible by 50."""
    e = table(spark, sf_dir, "symbol_embeddings").where("symbol_id IS NOT NULL").join(table(spark, sf_dir, "embedding_store").select("store_id", "dim").dropDuplicates(["store_id"]), "store_id")
    e = e.where(F.size("embedding") == F.col("dim")).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    v = materialize(e.select(F.col("symbol_id").alias("id"), "embedding").distinct(), "usable")
    return ranking.semantic_topk(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"))
