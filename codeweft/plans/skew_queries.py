"""Queries of the skew-safe aggregations over ``edges`` (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import skew
from codeweft.registry import CORE
from codeweft.sources.tables import edge_kind, table

#: Share of the distinct links from which a (target, kind) pair is reported.
DOMINANT_SHARE = 0.02

_LINKS = "SELECT from_id, to_id, lower(trim(kind)) AS kind FROM edges WHERE to_id IS NOT NULL AND kind IS NOT NULL"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges")
    return e.where(F.col("to_id").isNotNull() & F.col("kind").isNotNull()).select("from_id", "to_id", edge_kind(F.col("kind")).alias("kind"))


@CORE.add("p5_fan_in", f"SELECT to_id, kind, count(*) AS n_rows, count(DISTINCT from_id) AS n_distinct FROM ({_LINKS}) GROUP BY to_id, kind")
def p5_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and distinct sources per (target, kind)."""
    return skew.salted_distinct_count(links(spark, sf_dir), ["to_id", "kind"], "from_id")


@CORE.add(
    "p5_found",
    f"""WITH d AS (SELECT DISTINCT * FROM ({_LINKS}))
    SELECT to_id, kind FROM d GROUP BY to_id, kind HAVING count(*) >= {DOMINANT_SHARE} * (SELECT count(*) FROM d)""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (target, kind) pairs that hold at least 2 % of the distinct links."""
    return skew.dominant_keys(links(spark, sf_dir), ["to_id", "kind"], "from_id", DOMINANT_SHARE).select("to_id", "kind")


@CORE.add("p5_fan_out", f"SELECT from_id, kind, count(*) AS n_rows, count(DISTINCT to_id) AS n_distinct FROM ({_LINKS}) GROUP BY from_id, kind")
def p5_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and distinct targets per (source, kind)."""
    return skew.salted_distinct_count(links(spark, sf_dir), ["from_id", "kind"], "to_id")
