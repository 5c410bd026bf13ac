"""Queries of the vector search (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import neighbours
from codeweft.llm.registry import LLM
from codeweft.plans.materialize import materialize
from codeweft.sources.tables import table

#: Least cosine of a reported pair.
CLOSE = 0.85


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar(table(spark, sf_dir, "symbol_embeddings"), table(spark, sf_dir, "embedding_store"))


_SQL = """WITH v AS (SELECT DISTINCT symbol_id AS id, dim, CAST(embedding AS DOUBLE[]) AS e FROM symbol_embeddings JOIN embedding_store USING (store_id) WHERE symbol_id IS NOT NULL AND len(embedding) = dim
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    c AS (SELECT a.id, b.id AS other, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM v a JOIN v b ON a.dim = b.dim AND a.id <> b.id),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM c) WHERE place <= 5)
    SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM t WHERE cosine >= 0.85"""


@LLM.add("p2_found", _SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar of the other, with a cosine of at least 0.85."""
    return neighbours.within(_similar(spark, sf_dir), CLOSE)


@LLM.add("p2_neighbours")
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar symbols of every usable vector."""
    return _similar(spark, sf_dir)


@LLM.add("p2_recall")
def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the lists of every id divisible by 50 against brute force over all vectors."""
    found = materialize(_similar(spark, sf_dir), "found")
    return neighbours.recall(found, table(spark, sf_dir, "symbol_embeddings"), table(spark, sf_dir, "embedding_store"))


_RECALL = _SQL.split("    SELECT DISTINCT least")[0] + "    SELECT count(*) AS n_expected, true AS reached FROM t WHERE id % 50 = 0"


@LLM.add("p2_recall_reached", _RECALL)
def p2_recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of places in the exact lists of every id divisible by 50, and whether 0.9 of them were found."""
    return p2_recall(spark, sf_dir).select("n_expected", (F.col("recall") >= 0.9).alias("reached"))
