"""Queries of the graph operators over ``symbols``, ``library_symbols`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import graph
from codeweft.plans.materialize import materialize
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources.tables import nodes, table

HUBS = 3


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf_dir)
    return graph.links(table(spark, sf_dir, "edges"), n), n


@CORE.add("e07_links", with_views("SELECT from_id, to_id, kind FROM link"))
def e07_links(spark, sf_dir):
    return _links(spark, sf_dir)[0]


@CORE.add("g01_neighbours", with_views("SELECT to_id AS id, from_id AS other, 'in' AS direction FROM link UNION ALL SELECT from_id, to_id, 'out' FROM link"))
def g01_neighbours(spark, sf_dir):
    return graph.neighbours(_links(spark, sf_dir)[0])


@CORE.add("g02_centrality", with_views("SELECT id, n_in, n_out, raw, round(centrality, 6) AS centrality FROM cent"))
def g02_centrality(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    return graph.centrality(graph.degrees(link, n)).select("id", "n_in", "n_out", "raw", F.round("centrality", 6).alias("centrality"))


@CORE.add("g03_half_point", with_views("SELECT k FROM kval"))
def g03_half_point(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    return graph.half_point(graph.degrees(link, n))


@CORE.add(
    "g04_family",
    with_views(
        """SELECT t.id, d.n_in + coalesce(h.heirs, 0) AS total, round((d.n_in + coalesce(h.heirs, 0)) / (d.n_in + coalesce(h.heirs, 0) + 5.0), 6) AS family_score
        FROM node t JOIN deg d USING (id) LEFT JOIN (SELECT array_to_string(string_split(name, '::')[1:i], '::') AS name, sum(n_in) AS heirs FROM (
            SELECT name, n_in, unnest(generate_series(1, len(string_split(name, '::')) - 1)) AS i FROM node JOIN deg USING (id)) GROUP BY 1) h ON h.name = t.name
        WHERE t.kind IN ('class','interface','type_alias','enum','struct','trait','module')"""
    ),
)
def g04_family(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    return graph.family(graph.degrees(link, n), n).select("id", "total", F.round("family_score", 6).alias("family_score"))


@CORE.add("g04b_in_degree_score", with_views("SELECT id, round(n_in / (n_in + 5.0), 6) AS in_score FROM deg"))
def g04b_in_degree_score(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    return graph.degrees(link, n).select("id", F.round(F.col("n_in") / (F.col("n_in") + 5.0), 6).alias("in_score"))


def _hubs(link: DataFrame, n: DataFrame) -> DataFrame:
    """The symbols with the most dependents: what a user would ask about first (a top-k report)."""
    return graph.degrees(link, n).orderBy(F.desc("n_in"), "id").limit(HUBS).select("id")


_HUB = f"hub AS (SELECT id FROM deg ORDER BY n_in DESC, id LIMIT {HUBS})"
_BLAST = f"""{_HUB}, walk(seed, id, depth) AS (SELECT id, id, 0 FROM hub UNION SELECT w.seed, l.from_id, w.depth + 1 FROM walk w JOIN link l ON l.to_id = w.id WHERE w.depth < 4),
    blast AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0)"""


@CORE.add("g06_blast_radius", with_views(f"WITH RECURSIVE {_BLAST} SELECT seed, id, depth FROM blast"))
def g06_blast_radius(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    link = materialize(link, "links")
    return graph.blast_radius(link, _hubs(link, n))


@CORE.add(
    "g07_impact",
    with_views(
        f"""WITH RECURSIVE {_BLAST}, lists AS (SELECT h.id AS seed, 'direct' AS relation, l.from_id AS id FROM hub h JOIN link l ON l.to_id = h.id UNION ALL SELECT seed, 'transitive', id FROM blast),
        ranked AS (SELECT seed, relation, x.id, fqn, row_number() OVER (PARTITION BY seed, relation ORDER BY floor(centrality * 1e6) DESC, fqn, x.id) AS place,
            count(*) OVER (PARTITION BY seed, relation) AS n_list, count(*) OVER (PARTITION BY seed) AS total_affected FROM lists x JOIN node n ON n.id = x.id JOIN cent c ON c.id = x.id)
        SELECT seed, relation, place, id, fqn, total_affected, greatest(n_list - 100, 0) AS truncated FROM ranked WHERE place <= 100"""
    ),
)
def g07_impact(spark, sf_dir):
    link, n = _links(spark, sf_dir)
    link = materialize(link, "links")
    return graph.impact(link, n, graph.centrality(graph.degrees(link, n)), _hubs(link, n))


@CORE.add("g05_logic_flow")
def g05_logic_flow(spark, sf_dir):
    """Shortest dependency paths from the symbols with most dependencies to those with most dependents."""
    link, n = _links(spark, sf_dir)
    link = materialize(link, "links")
    far = graph.degrees(link, n).orderBy(F.desc("n_out"), "id").limit(HUBS).select(F.col("id").alias("from_id"))
    pairs = far.withColumn("j", F.lit(1)).join(_hubs(link, n).select(F.col("id").alias("to_id"), F.lit(1).alias("j")), "j").select("from_id", "to_id")
    return graph.shortest_paths(link, pairs)


_TYPED = ("lock", "queue_channel", "Budget", "kernel")


@CORE.add(
    "g09_suggestions",
    with_views(
        "SELECT query, place, fqn, score FROM (SELECT query, fqn, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, fqn) AS place FROM ("
        "SELECT query, fqn, CASE WHEN contains(lower(name), lower(query)) THEN 2 ELSE 1 END AS score FROM node, (VALUES "
        + ", ".join(f"('{q}')" for q in _TYPED)
        + ") t(query) WHERE contains(lower(name), lower(query)) OR contains(lower(fqn), lower(query))) GROUP BY query, fqn) WHERE place <= 5"
    ),
)
def g09_suggestions(spark, sf_dir):
    return graph.suggestions(nodes(spark, sf_dir), spark.createDataFrame([(q,) for q in _TYPED], "query string"))


@CORE.add("g10_name_prefix", with_views("SELECT id, name FROM node WHERE lower(name) LIKE 'queue%'"))
def g10_name_prefix(spark, sf_dir):
    return nodes(spark, sf_dir).where(F.lower("name").startswith("queue")).select("id", "name")


@CORE.add("g11_first_by_fqn", with_views("SELECT fqn, min(id) AS id, count(*) AS n FROM node WHERE fqn IS NOT NULL GROUP BY fqn"))
def g11_first_by_fqn(spark, sf_dir):
    return nodes(spark, sf_dir).where("fqn IS NOT NULL").groupBy("fqn").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@CORE.add("g12_file_symbols", with_views("SELECT file_path, count(*) AS n_symbols, min(start_line) AS first_line, max(end_line) AS last_line FROM sym GROUP BY file_path"))
def g12_file_symbols(spark, sf_dir):
    from codeweft.sources.tables import symbols

    return symbols(spark, sf_dir).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


