"""Queries of the near-duplicate join (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm import neardup
from codeweft.llm.registry import LLM
from codeweft.plans.materialize import materialize
from codeweft.sources.tables import table


_SQL = """WITH d AS (SELECT DISTINCT id, body FROM symbols WHERE id IS NOT NULL AND body IS NOT NULL), e AS (SELECT * FROM (SELECT id, body, list_transform(regexp_extract_all(body, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM d) WHERE len(w) >= 40),
    g AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM e), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
    SELECT a AS id_a, b AS id_b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN e ea ON ea.id = a JOIN e eb ON eb.id = b WHERE ea.body <> eb.body AND CAST(c AS DOUBLE) / (x.n + y.n - c) >= 0.55"""


@LLM.add("p4_found", _SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids with different bodies that share 0.55 of their three-word runs."""
    members, hits = neardup.class_pairs(table(spark, sf_dir, "symbols"), "id", "body")
    return neardup.id_pairs(members, hits).select("id_a", "id_b")


@LLM.add("p4_groups")
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol that has a near or exact copy, with its group and its number of links."""
    members, hits = neardup.class_pairs(table(spark, sf_dir, "symbols"), "id", "body")
    return neardup.groups(materialize(members, "members"), materialize(hits, "hits"))
