"""Queries of edge extraction, packing and diffs over the whole symbol table."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import capsule, diff, edges, graph
from codeweft.plans import pipeline
from codeweft.plans.materialize import materialize
from codeweft.plans.search_queries import _selection, tasks
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources.tables import nodes, symbols, table

_CALLABLE = "('function','async_function','method','async_method')"
_TYPES = "('class','interface','type_alias','enum','struct','trait')"


@CORE.add("e01_imports")
def e01_imports(spark, sf_dir):
    return edges.imports(symbols(spark, sf_dir))


@CORE.add("e02_implements")
def e02_implements(spark, sf_dir):
    return edges.implements(symbols(spark, sf_dir))


@CORE.add(
    "e03_calls",
    with_views(
        f"""SELECT DISTINCT t.id AS from_id, n.to_id FROM (SELECT id, unnest(list_distinct(regexp_extract_all(CASE WHEN language = 'python' THEN regexp_replace(body, '(?s)\"\"\".*?\"\"\"|''''''.*?''''''', '', 'g') ELSE body END, '([A-Za-z0-9_]+) *\\(', 1))) AS token
        FROM sym WHERE kind IN {_CALLABLE} AND octet_length(encode(body)) >= 20) t JOIN (SELECT name AS token, id AS to_id FROM sym WHERE kind <> 'import' UNION SELECT leaf_name, id FROM sym WHERE kind <> 'import') n ON n.token = t.token
        WHERE t.id <> n.to_id AND length(t.token) > 2 AND NOT regexp_matches(t.token, '^[0-9]') AND t.token NOT IN ({', '.join(f"'{w}'" for w in edges.NO_CALLS)})"""
    ),
)
def e03_calls(spark, sf_dir):
    return edges.calls(symbols(spark, sf_dir)).select("from_id", "to_id")


@CORE.add(
    "e04_references",
    with_views(
        f"""SELECT DISTINCT t.id AS from_id, n.id AS to_id FROM (SELECT id, unnest(regexp_extract_all(string_split(body, chr(10))[1], '([A-Z][A-Za-z0-9_]+)', 1)) AS token FROM sym WHERE kind IN {_CALLABLE} AND body IS NOT NULL) t
        JOIN sym n ON n.name = t.token AND n.kind IN {_TYPES} WHERE t.id <> n.id"""
    ),
)
def e04_references(spark, sf_dir):
    return edges.references(symbols(spark, sf_dir)).select("from_id", "to_id")


_WORDS = ", ".join(f"'{w}'" for w in edges.SHELL_WORDS)


@CORE.add(
    "e05_shell_calls",
    with_views(
        f"""SELECT f.id AS from_id, n.id AS to_id, 'calls' AS kind, min(w) AS label FROM (SELECT id, unnest(list_distinct(list_transform(regexp_split_to_array(body, '[\\n;|&{{(]'),
        lambda x: regexp_replace(regexp_split_to_array(regexp_replace(regexp_replace(x, '^\\s+', ''), '^\\$*\\(*', ''), '\\s+')[1], '[^\\p{{L}}\\p{{N}}_]+$', '')))) AS w FROM sym WHERE language = 'shell' AND kind = 'function' AND body IS NOT NULL) f
        JOIN sym n ON n.name = f.w AND n.language = 'shell' AND n.kind = 'function' WHERE f.id <> n.id AND regexp_matches(w, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_-]*$') AND octet_length(encode(w)) >= 2 AND w NOT IN ({_WORDS}) GROUP BY 1, 2"""
    ),
)
def e05_shell_calls(spark, sf_dir):
    return edges.shell_calls(symbols(spark, sf_dir))


@CORE.add("e06_sql_references")
def e06_sql_references(spark, sf_dir):
    return edges.sql_references(symbols(spark, sf_dir))


@CORE.add("e_all_extracted")
def e_all_extracted(spark, sf_dir):
    return edges.extract(symbols(spark, sf_dir))


def _packed(spark, sf_dir):
    s = symbols(spark, sf_dir)
    q = pipeline.prepared(tasks(spark, sf_dir))
    sel = _selection(spark, sf_dir)
    full = materialize(capsule.pack_pivots(sel.pivots, s, q), "packed")
    return s, q, full, capsule.pack_adjacents(full, sel.adjacents, s, q)


@CORE.add("r22_capsules")
def r22_capsules(spark, sf_dir):
    """The whole way from each logged task to its packed capsule: sizes."""
    _, q, full, brief = _packed(spark, sf_dir)
    return capsule.summary(full, brief, q)


@CORE.add("c02_markdown")
def c02_markdown(spark, sf_dir):
    s, q, full, brief = _packed(spark, sf_dir)
    return capsule.render(full, brief, s, q)


@CORE.add("c04_skeletons")
def c04_skeletons(spark, sf_dir):
    """The outline of every symbol."""
    return capsule.file_skeleton(symbols(spark, sf_dir))


#: A change to the shared test project, as a reviewer would paste it.
DIFF = """diff --git a/ws0000001/src/gauge/lazy_range.swift b/ws0000001/src/gauge/lazy_range.swift
--- a/ws0000001/src/gauge/lazy_range.swift
+++ b/ws0000001/src/gauge/lazy_range.swift
@@ -10,4 +10,60 @@ context
+added
@@ -200 +256,3 @@
+added
--- a/ws0000003/src/gone.rs
+++ /dev/null
@@ -1,5 +0,0 @@
--- a/ws0000003/src/span/public_layer.rs
+++ b/ws0000003/src/span/public_layer.rs
@@ -1 +1 @@
"""
_HUNKS = "hunk(diff_id, file_path, first, last) AS (VALUES (1, 'ws0000001/src/gauge/lazy_range.swift', 10, 69), (1, 'ws0000001/src/gauge/lazy_range.swift', 256, 258), (1, 'ws0000003/src/span/public_layer.rs', 1, 1))"


def _diffs(spark):
    return spark.createDataFrame([(1, DIFF)], "diff_id int, diff string")


@CORE.add("g08_hunks", f"WITH {_HUNKS} SELECT * FROM hunk")
def g08_hunks(spark, sf_dir):
    return diff.hunks(_diffs(spark))


@CORE.add("f08_touched", with_views(f"WITH {_HUNKS} SELECT DISTINCT diff_id, id FROM hunk JOIN sym USING (file_path) WHERE start_line <= last AND end_line >= first"))
def f08_touched(spark, sf_dir):
    return diff.touched(diff.hunks(_diffs(spark)), symbols(spark, sf_dir))


@CORE.add(
    "c03_diff_impact",
    with_views(
        f"""WITH {_HUNKS}, p AS (SELECT DISTINCT diff_id, id FROM hunk JOIN sym USING (file_path) WHERE start_line <= last AND end_line >= first),
        dep AS (SELECT DISTINCT p.diff_id, l.from_id AS id FROM p JOIN link l ON l.to_id = p.id WHERE (p.diff_id, l.from_id) NOT IN (SELECT (diff_id, id) FROM p)),
        near AS (SELECT diff_id, id FROM (SELECT DISTINCT p.diff_id, t.id FROM p JOIN sym s ON s.id = p.id JOIN sym t ON regexp_matches(t.file_path, '/test|_test\\.|test_|/spec|_spec\\.') AND list_contains(regexp_split_to_array(coalesce(t.body, ''), '\\W+'), s.leaf_name))
            WHERE (diff_id, id) NOT IN (SELECT (diff_id, id) FROM p) AND (diff_id, id) NOT IN (SELECT (diff_id, id) FROM dep) QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY id) <= 5)
        SELECT diff_id, id, 'pivot' AS role FROM p UNION ALL SELECT diff_id, id, 'dependent' FROM dep UNION ALL SELECT diff_id, id, 'test' FROM near"""
    ),
)
def c03_diff_impact(spark, sf_dir):
    s = symbols(spark, sf_dir)
    link = graph.links(table(spark, sf_dir, "edges"), nodes(spark, sf_dir))
    return diff.impact(diff.touched(diff.hunks(_diffs(spark)), s), link, s)


@CORE.add("x12_embedding_texts", with_views(f"""SELECT id, CASE WHEN trim(coalesce(signature, ''), ' ') = '' THEN name WHEN kind IN {_TYPES} OR kind = 'impl' THEN concat_ws(chr(10), signature, nullif(docstring, ''), left(coalesce(body, ''), 500))
    WHEN language = 'markdown' THEN concat_ws(chr(10), signature, left(coalesce(body, ''), 1000)) ELSE concat_ws(chr(10), signature, nullif(docstring, '')) END AS text FROM sym WHERE kind IS NOT NULL"""))
def x12_embedding_texts(spark, sf_dir):
    from codeweft.functions.text import embedding_text

    c = F.col
    chars = lambda b, n: F.left(b, F.lit(n))
    return symbols(spark, sf_dir).where("kind IS NOT NULL").select("id", embedding_text(c("kind"), c("language"), c("name"), c("signature"), c("docstring"), c("body"), chars).alias("text"))


_BYTES = "left(b, list_max(list_filter(generate_series(0, least(length(b), {0})), lambda i: octet_length(encode(left(b, i))) <= {0})))"


@CORE.add("x12_embedding_texts_bytes", with_views(f"""SELECT id, CASE WHEN trim(coalesce(signature, ''), ' ') = '' THEN name WHEN kind IN {_TYPES} OR kind = 'impl' THEN concat_ws(chr(10), signature, nullif(docstring, ''), {_BYTES.format(500)})
    WHEN language = 'markdown' THEN concat_ws(chr(10), signature, {_BYTES.format(1000)}) ELSE concat_ws(chr(10), signature, nullif(docstring, '')) END AS text FROM (SELECT *, coalesce(body, '') AS b FROM sym WHERE kind IS NOT NULL)"""))
def x12_embedding_texts_bytes(spark, sf_dir):
    """The text that an embedder gets of every symbol, bodies cut in bytes."""
    from codeweft.functions.text import embedding_text

    c = F.col
    return symbols(spark, sf_dir).where("kind IS NOT NULL").select("id", embedding_text(c("kind"), c("language"), c("name"), c("signature"), c("docstring"), c("body")).alias("text"))


@CORE.add("x14_python_types", with_views("""SELECT id, CASE WHEN r <> '' THEN r END AS return_type FROM (SELECT id, trim(regexp_replace(regexp_extract(signature, '^.* -> (.+)$', 1), ':\\s*$', ''), ' ') AS r FROM sym WHERE language = 'python' AND signature IS NOT NULL)"""))
def x14_python_types(spark, sf_dir):
    from codeweft.functions.text import return_type

    return symbols(spark, sf_dir).where("language = 'python' AND signature IS NOT NULL").select("id", return_type(F.col("signature")).alias("return_type"))
