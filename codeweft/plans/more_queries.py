"""Queries of the single stages of ranking, text functions and enrichment that the pipelines are made of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codeweft.functions import anchors as A
from codeweft.functions import text as X
from codeweft.operators import blocks, capsule, enrich, graph, memory, ranking, stats, store
from codeweft.plans import pipeline
from codeweft.plans.materialize import materialize
from codeweft.plans.search_queries import _FUSED, _INTENT, _searched, _selection, tasks
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources.tables import nodes, observations, symbols, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


_CALL = "([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)\\s*\\("
_TAIL = "len({0}) + len(list_filter({0}, lambda x: contains(x, '.')))"


@CORE.add("x02_calls", f"SELECT doc_id, {_TAIL.format(f"regexp_extract_all(text, '{_CALL}', 1)")} AS n FROM documents WHERE text IS NOT NULL")
def x02_calls(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(A.calls(F.col("text"))).cast("long").alias("n"))


@CORE.add("x04_frames", "SELECT doc_id, len(regexp_extract_all(text, 'File \"([^\"]+)\", line \\d+, in ([A-Za-z_<][\\w.<>]*)', 1)) AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, 'in <|in \\w{1,2}\\s') ")
def x04_frames(spark, sf_dir):
    d = _docs(spark, sf_dir).where(~F.col("text").rlike(r"in <|in \w{1,2}\s"))
    return d.select("doc_id", F.size(A.frames(F.col("text"), anywhere=True)).cast("long").alias("n"))


_STOPS = ", ".join(f"'{w}'" for w in A.STOP_WORDS)


@CORE.add(
    "x04_frames_all",
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, 'File "([^"]+)", line \\d+, in ([A-Za-z_<][\\w.<>]*)', 2), lambda x: NOT starts_with(x, '<') AND octet_length(encode(x)) >= 3 AND lower(x) NOT IN ({_STOPS}))) AS n
    FROM documents WHERE text IS NOT NULL""",
)
def x04_frames_all(spark, sf_dir):
    """Traceback frames of every document, also inside a line, synthetic and short names left out."""
    return _docs(spark, sf_dir).select("doc_id", F.size(A.frames(F.col("text"), anywhere=True)).cast("long").alias("n"))


@CORE.add(
    "x04_line_frames",
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?m)^\\s*File\\s+"([^"]+)",\\s*line\\s+\\d+,\\s*in\\s+([A-Za-z_<][A-Za-z0-9_<>.]*)', 2), lambda x: NOT starts_with(x, '<') AND octet_length(encode(x)) >= 3 AND lower(x) NOT IN ({_STOPS}))) AS n
    FROM documents WHERE text IS NOT NULL""",
)
def x04_line_frames(spark, sf_dir):
    """Traceback frames that begin their line, as the ranking takes them."""
    return _docs(spark, sf_dir).select("doc_id", F.size(A.frames(F.col("text"))).cast("long").alias("n"))


@CORE.add("x11_cut", "SELECT doc_id, left(text, list_max(list_filter(generate_series(0, least(length(text), 100)), lambda i: octet_length(encode(left(text, i))) <= 100))) AS head FROM documents WHERE text IS NOT NULL")
def x11_cut(spark, sf_dir):
    """The first 100 bytes of every text, no character cut."""
    return _docs(spark, sf_dir).select("doc_id", X.cut_bytes(F.col("text"), 100).alias("head"))


@CORE.add("x05_prose_names", f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '([A-Za-z0-9_]{{4,}})', 1), lambda x: regexp_matches(x, '^[A-Za-z_]') AND (contains(x, '_') OR (regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]'))) AND lower(x) NOT IN ({_STOPS}))) AS n FROM documents WHERE text IS NOT NULL")
def x05_prose_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(A.prose_names(F.col("text"))).cast("long").alias("n"))


@CORE.add("x06_dotted", "SELECT doc_id, 2 * len(regexp_extract_all(text, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+)\\b', 1)) AS n FROM documents WHERE text IS NOT NULL")
def x06_dotted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(A.dotted_names(F.col("text"))).cast("long").alias("n"))


_FROM_SQL = "(?:^|[\\s:;`])from\\s+([A-Za-z_][\\w.]*)\\s+import\\s+([A-Za-z_][\\w]*(?:\\s*,\\s*[A-Za-z_]\\w*)*)"
_IMPORT_SQL = "(?:^|[\\n:;`])[ \\t]*import\\s+([A-Za-z_][\\w.]*)"


@CORE.add(
    "x03_imports",
    f"""SELECT doc_id, list_concat(flatten(list_transform(regexp_extract_all(text, '{_FROM_SQL}', 2), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))), list_transform(regexp_extract_all(text, '{_IMPORT_SQL}', 1), lambda x: string_split(x, '.')[-1])) AS names,
    list_filter(m, lambda x, i: list_position(m, x) = i) AS modules FROM (SELECT doc_id, text, list_concat(regexp_extract_all(text, '{_FROM_SQL}', 1), regexp_extract_all(text, '{_IMPORT_SQL}', 1)) AS m FROM documents WHERE text IS NOT NULL)""",
)
def x03_imports(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", A.imported(t).alias("names"), A.module_paths(t).alias("modules"))


@CORE.add("r07_reverse_expand")
def r07_reverse_expand(spark, sf_dir):
    """Callers above every exception type, each asked for by its own name."""
    n, s = nodes(spark, sf_dir), symbols(spark, sf_dir)
    link = materialize(graph.links(table(spark, sf_dir, "edges"), n), "link")
    cent = graph.centrality(graph.degrees(link, n))
    kinds = s.where(F.col("kind").isin("class", "struct", "enum")).select(F.col("id").alias("query_id"), "id", F.col("name").alias("task"))
    # every type may be a seed here: the data has few names that end in Error
    seeds = s.withColumn("name", F.when(F.col("kind").isin("class", "struct", "enum"), F.concat("name", F.lit("Error"))).otherwise(F.col("name")))
    return ranking.reverse_expand(link, seeds, cent, kinds.withColumn("rank", F.lit(1)), kinds)


@CORE.add(
    "r11_injected",
    with_views(
        f"""WITH {_FUSED}, fam AS (SELECT t.id, (d.n_in + coalesce(h.heirs, 0)) / (d.n_in + coalesce(h.heirs, 0) + 5.0) AS family_score FROM node t JOIN deg d USING (id) LEFT JOIN (SELECT array_to_string(string_split(name, '::')[1:i], '::') AS name, sum(n_in) AS heirs FROM (
            SELECT name, n_in, unnest(generate_series(1, len(string_split(name, '::')) - 1)) AS i FROM node JOIN deg USING (id)) GROUP BY 1) h ON h.name = t.name WHERE t.kind IN ('class','interface','type_alias','enum','struct','trait','module')),
        best AS (SELECT id, 5.0 * family_score AS score FROM fam ORDER BY round(family_score, 6) DESC, id LIMIT 16)
        SELECT query_id, id, round(score, 6) AS score FROM fused UNION ALL SELECT t.query_id, b.id, round(b.score, 6) FROM tasks t, best b WHERE {_INTENT} = 'structural' AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = t.query_id AND f.id = b.id)"""
    ),
)
def r11_injected(spark, sf_dir):
    s, link, cent, hits = _searched(spark, sf_dir)
    n = nodes(spark, sf_dir)
    fused = materialize(ranking.fuse({"bm25": hits, "graph": ranking.graph_candidates(link, hits, cent)}), "fused")
    fam = graph.family(graph.degrees(link, n), n)
    return ranking.inject_structural(fused, fam, pipeline.prepared(tasks(spark, sf_dir))).select("query_id", "id", F.round("score", 6).alias("score"))


@CORE.add("r17_ranked")
def r17_ranked(spark, sf_dir):
    """The ranked candidates of every logged task after resorting, one row per name, stubs penalised."""
    return _selection(spark, sf_dir).ranked


@CORE.add("f01_filtered")
def f01_filtered(spark, sf_dir):
    """The same, for Python files only, by the tasks' filters."""
    ix = pipeline.Index.build(symbols(spark, sf_dir), nodes(spark, sf_dir), table(spark, sf_dir, "edges"))
    return pipeline.select(ix, tasks(spark, sf_dir).withColumn("language", F.lit("Python"))).ranked


@CORE.add("r14_semantic_blend")
def r14_semantic_blend(spark, sf_dir):
    """Fused candidates blended with the similarity of hashed words."""
    s, link, cent, hits = _searched(spark, sf_dir)
    q = tasks(spark, sf_dir)
    hashed = enrich.HashEmbedder()
    a = enrich.embed(q.select("query_id", "task"), "query_id", "task", hashed).withColumnRenamed("embedding", "q")
    b = enrich.embed(s.where("signature IS NOT NULL").select("id", "signature"), "id", "signature", hashed)
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda x, y: x + y)
    sem = hits.select("query_id", "id").join(a, "query_id").join(b, "id").select("query_id", "id", F.round(dot, 6).alias("similarity"))  # candidates only
    return ranking.semantic_blend(ranking.fuse({"bm25": hits}), sem)


@CORE.add("r21_memory")
def r21_memory(spark, sf_dir):
    """Live observations for every logged task by the similarity of hashed words, all of them compared with every task."""
    now = dt.datetime(2024, 9, 1)
    hashed = enrich.HashEmbedder()
    o = memory.live(observations(spark, sf_dir), now)
    a = enrich.embed(tasks(spark, sf_dir), "query_id", "task", hashed)
    b = enrich.embed(o.select("id", "content"), "id", "content", hashed)
    return memory.rank_similar(blocks.nearest(b, a, memory.SIMILAR, memory.LEAST_SIMILAR))


@CORE.add("a07_candidate_tokens", with_views("""WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/')[1] AS query_id FROM sym) SELECT query_id, CAST(sum(t) AS BIGINT) AS candidate_file_tokens,
    list_sort(list(DISTINCT regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))) AS languages_hit FROM p JOIN (SELECT file_path, sum(octet_length(encode(body)) // 4) AS t FROM sym GROUP BY 1) USING (file_path) GROUP BY 1"""))
def a07_candidate_tokens(spark, sf_dir):
    """Tokens and extensions of the candidate files, with every workspace as one query."""
    s = symbols(spark, sf_dir)
    return stats.candidate_tokens(s, s.select(F.substring_index("file_path", "/", 1).alias("query_id"), "file_path"))


@CORE.add("x08_windows")
def x08_windows(spark, sf_dir):
    """Every long body cut to the window that has most words of its own name."""
    import pandas as pd

    s = symbols(spark, sf_dir).where(F.octet_length("body") > 1200).select("id", "name", "body")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [capsule.chunk_for_query(b, (n or "").replace("_", " "), 300) for b, n in zip(pdf["body"], pdf["name"])]})

    return s.mapInPandas(run, "id long, text string")


@CORE.add("g13_without_files", with_views("SELECT file_path, count(*) AS n FROM sym WHERE NOT is_stub AND file_path NOT IN (SELECT file_path FROM sym WHERE is_stub AND file_path IS NOT NULL) GROUP BY 1"))
def g13_without_files(spark, sf_dir):
    """What remains when all files with stubs are removed."""
    s = symbols(spark, sf_dir)
    return store.without_files(s, s.where("is_stub").select(F.col("file_path").alias("path"))).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("m14_delete", with_views("SELECT id FROM obs WHERE kind IS DISTINCT FROM 'auto'"))
def m14_delete(spark, sf_dir):
    o = observations(spark, sf_dir)
    return memory.delete(o, o.where("kind = 'auto'")).select("id")


@CORE.add(
    "n02_rust_types",
    with_views(
        """SELECT s.id, f.type AS resolved_type, coalesce(s.source, 'rustdoc') AS source FROM sym s JOIN (SELECT leaf_name AS key, min(regexp_extract(signature, '-> (.+)$', 1)) AS type FROM sym
        WHERE language = 'rust' AND contains(signature, '-> Result<') AND leaf_name IS NOT NULL GROUP BY 1) f ON string_split(s.name, '::')[-1] = f.key AND (s.name = f.key OR ends_with('::' || s.fqn, '::' || f.key)) WHERE s.language = 'rust'"""
    ),
)
def n02_rust_types(spark, sf_dir):
    """Types from two documents of the Rust documentation's form, merged into the symbol table: the changed rows."""
    s = symbols(spark, sf_dir)
    facts = s.where("language = 'rust' AND signature LIKE '%-> Result<%'").select(F.col("leaf_name").alias("key"), F.regexp_extract("signature", r"-> (.+)$", 1).alias("type"))
    return enrich.rust_types(s.withColumn("resolved_type", F.lit(None).cast("string")), facts).where("resolved_type IS NOT NULL").select("id", "resolved_type", "source")


@CORE.add(
    "n04_script_types",
    with_views(
        """SELECT s.id, f.type AS resolved_type FROM sym s JOIN (SELECT fqn, min(regexp_extract(signature, '\\): (\\w+)', 1)) AS type FROM sym WHERE language = 'typescript' AND regexp_matches(signature, '\\): [A-Z]') AND fqn IS NOT NULL GROUP BY 1) f USING (fqn)
        WHERE s.language IN ('typescript', 'tsx', 'javascript', 'jsx')"""
    ),
)
def n04_script_types(spark, sf_dir):
    s = symbols(spark, sf_dir)
    facts = s.where("language = 'typescript' AND signature RLIKE '\\\\): [A-Z]'").select("fqn", F.regexp_extract("signature", r"\): (\w+)", 1).alias("resolved_type"))
    return enrich.script_types(s.withColumn("resolved_type", F.lit(None).cast("string")), facts).where("resolved_type IS NOT NULL").select("id", "resolved_type")


@CORE.add("n01_expanded", with_views("SELECT count(*) AS n FROM (SELECT id FROM sym UNION ALL SELECT -id FROM sym WHERE language = 'rust' AND fqn IS NOT NULL)"))
def n01_expanded(spark, sf_dir):
    """Symbols of expanded Rust source added where their name is new."""
    s = symbols(spark, sf_dir)
    new = s.where("language = 'rust' AND fqn IS NOT NULL").withColumns({"id": -F.col("id"), "fqn": F.concat("fqn", F.lit("::expanded"))})
    return enrich.add_expanded(s, new.unionByName(s.where("language = 'rust'"))).agg(F.count(F.lit(1)).alias("n"))
