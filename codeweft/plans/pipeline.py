"""From tasks to selected symbols, all tasks of a table in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import intent
from codeweft.operators import bm25, graph, ranking
from codeweft.plans.materialize import materialize


@dataclass
class Index:
    """The tables that searching needs; built once per state of the workspace."""

    symbols: DataFrame
    link: DataFrame
    cent: DataFrame
    family: DataFrame
    postings: bm25.Postings | None = None

    @classmethod
    def build(cls, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, postings: bool = False) -> Index:
        """With ``postings`` all words are indexed, which pays off for an index that is asked again and again."""
        symbols = materialize(symbols, "symbols")  # cleaned once, not in every branch
        link = materialize(graph.links(edges, nodes), "link")
        deg = materialize(graph.degrees(link, nodes), "deg")
        return cls(symbols, link, materialize(graph.centrality(deg), "cent"), materialize(graph.family(deg, nodes), "family"), bm25.Postings.build(symbols) if postings else None)


def prepared(queries: DataFrame) -> DataFrame:
    """``query_id``, ``task``, ``intent`` and the optional filters, null where the table lacks them. Null tasks are left out."""
    have = set(queries.columns)
    opt = {"language": "string", "file_hint": "string", "min_score": "double", "context": "string", "budget": "int"}
    cols = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in opt.items()]
    return queries.where("task IS NOT NULL").select("query_id", "task", *cols).withColumn("intent", intent(F.col("task")))


@dataclass
class Selection:
    ranked: DataFrame
    pivots: DataFrame
    adjacents: DataFrame


def select(ix: Index, queries: DataFrame, semantic: DataFrame | None = None, max_pivots: int = ranking.PIVOTS) -> Selection:
    """Retrieval, fusion, reranking and selection for a table of tasks (``query_id``, ``task``, optional filters).

    ``context`` feeds the names and tracebacks only. ``semantic`` has the similarities (``query_id``, ``id``, ``rank``, ``similarity``) if there
    is an embedder.
    """
    q = materialize(prepared(queries), "queries")
    hits = materialize(bm25.search(ix.symbols, q, built=ix.postings), "bm25")
    told = q.withColumn("task", F.concat_ws("\n", "task", "context"))
    named = materialize(ranking.anchor_candidates(ix.symbols, told), "anchors")
    lists = {"bm25": hits, "graph": ranking.graph_candidates(ix.link, hits, ix.cent), "anchor": named, "traceback": ranking.traceback_candidates(ix.symbols, told)}
    back = materialize(ranking.reverse_expand(ix.link, ix.symbols, ix.cent, named, told, semantic), "reverse")
    lists["reverse"] = back
    if semantic is not None:
        lists["semantic"] = semantic
    s = ranking.inject_structural(materialize(ranking.fuse(lists), "fused"), ix.family, q, max_pivots)
    s = ranking.centrality_boost(ranking.proximity(s, ix.symbols, q), ix.symbols, ix.cent)
    if semantic is not None:
        s = ranking.semantic_blend(s, semantic)
    s = ranking.structural_resort(materialize(s, "scored"), ix.symbols, ix.family, q, hits)
    ranked = materialize(ranking.post_filter(ranking.dedup_and_penalise(s, ix.symbols), ix.symbols, q), "ranked")
    chosen = materialize(ranking.pivots(ranked, ix.symbols, named, back, max_pivots), "pivots")
    return Selection(ranked, chosen, ranking.adjacents(chosen, ix.link, ix.symbols, q))
