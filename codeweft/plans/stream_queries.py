"""Queries of the streaming operators, run to the end over what the tables hold, and of enrichment and consolidation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codeweft.operators import enrich, memory
from codeweft.plans.materialize import shared_dir
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources import extract as X
from codeweft.sources.tables import observations, symbols, table
from codeweft.streaming import changes as C


def _run(spark, stream, schema: str):
    """Runs a stream over all that is there and returns its rows as a table in the shared folder."""
    import uuid

    base = f"{shared_dir(spark)}/codeweft/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _table_stream(spark, sf_dir: str, name: str):
    """A table as a stream of its files."""
    import os

    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = path if not os.path.isfile(path) else sf_dir
    reader = spark.readStream.schema(schema)
    return reader.parquet(source) if source == path else reader.option("pathGlobFilter", f"{name}.parquet").parquet(source)


@CORE.add(
    "t05_stream_thrash",
    """SELECT path, ts, n FROM (SELECT CAST(user_id AS VARCHAR) AS path, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW) AS n
    FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) WHERE n >= 4""",
)
def t05_stream_thrash(spark, sf_dir):
    """The streaming form of m05_thrash over the same events."""
    e = _table_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    out = _run(spark, C.thrash_stream(e, seconds=6 * 3600), "path string, ts timestamp, n long")
    return out.select("path", F.col("ts").cast("timestamp_ntz").alias("ts"), "n")


@CORE.add(
    "t06_stream_suppress",
    """WITH RECURSIVE runs AS (SELECT CAST(user_id AS VARCHAR) AS task, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    fold(task, rn, t, last, kept) AS (SELECT task, rn, t, t, true FROM runs WHERE rn = 1 UNION ALL SELECT r.task, r.rn, r.t, CASE WHEN r.t - f.last >= INTERVAL 30 MINUTE THEN r.t ELSE f.last END, r.t - f.last >= INTERVAL 30 MINUTE
    FROM fold f JOIN runs r ON r.task = f.task AND r.rn = f.rn + 1) SELECT task, t AS ts FROM fold WHERE kept""",
)
def t06_stream_suppress(spark, sf_dir):
    """Events of a user that are recorded when those within half an hour of the last recorded one are skipped."""
    e = _table_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), "ts")
    out = _run(spark, C.suppress_stream(e), "task string, ts timestamp")
    return out.select("task", F.col("ts").cast("timestamp_ntz").alias("ts"))


@CORE.add(
    "t03_fold_changes",
    """SELECT path, kind, ts, n FROM (SELECT CAST(user_id AS VARCHAR) AS path, event_type AS kind, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1""",
)
def t03_fold_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), "ts")
    return C.fold_batch(e)


@CORE.add("f11_watched", "SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') OR p IN ('node_modules','target','__pycache__','.git','dist','build','.build'))) = 0 AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN (" + ", ".join(f"'{e}'" for e in C.WATCHED) + ")")
def f11_watched(spark, sf_dir):
    return table(spark, sf_dir, "files").where(C.watched(F.col("path"))).select("path").distinct()


@CORE.add("n03_python_types", with_views("""SELECT id, CASE WHEN resolved_type IS NULL AND language = 'python' AND kind IN ('function','async_function','method','async_method') AND r <> '' THEN r
    WHEN resolved_type IS NULL AND language = 'python' AND kind = 'class' AND len(b) > 0 THEN array_to_string(b, ', ') ELSE resolved_type END AS resolved_type FROM (SELECT *, trim(regexp_replace(regexp_extract(signature, '^.* -> (.+)$', 1), ':\\s*$', ''), ' ') AS r,
    list_filter(list_transform(string_split(regexp_extract(signature, '^class\\s+\\w+\\s*\\(+([^()]*)\\)', 1), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS b FROM sym)"""))
def n03_python_types(spark, sf_dir):
    """Types of Python symbols from their signatures."""
    none = spark.createDataFrame([], "file_path string, line int, type string")
    return enrich.python_types(symbols(spark, sf_dir), none).select("id", "resolved_type")


_USUAL = "'println','print','eprintln','eprint','format','vec','assert','assert_eq','assert_ne','debug_assert','panic','todo','unimplemented','unreachable','write','writeln','matches','dbg','include_str','env','concat','stringify'"


@CORE.add(
    "x19_macro_users",
    with_views(
        f"""SELECT id, replace(regexp_replace(regexp_extract(file_path, '(?:^|/)src/(.*)\\.rs$', 1), '(?:^|/)(?:mod|lib|main)$', ''), '/', '::') AS module FROM sym WHERE language = 'rust' AND body IS NOT NULL
        AND (contains(body, '#[derive(') OR len(list_filter(regexp_extract_all(body, '(?:^|[^\\w])([a-z_][a-z0-9_]*)!\\s*[({{\\[]', 1), lambda x: x NOT IN ({_USUAL}))) > 0)"""
    ),
)
def x19_macro_users(spark, sf_dir):
    s = symbols(spark, sf_dir).where("language = 'rust' AND body IS NOT NULL")
    return s.where(enrich.uses_macros(F.col("body"))).select("id", enrich.module_path(F.col("file_path")).alias("module"))


@CORE.add("xp_extract_bodies")
def xp_extract_bodies(spark, sf_dir):
    """What the extractors find in every body, read as a file of its own: rows per language and kind."""
    s = symbols(spark, sf_dir).where("body IS NOT NULL AND language IS NOT NULL").select(F.col("id").cast("string").alias("path"), F.col("body").alias("content"), "language")
    return X.extract(s).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("xp_extract_documents")
def xp_extract_documents(spark, sf_dir):
    """Sections of all documents, read as Markdown."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return X.extract(d).select("file_path", "name", "start_line", "end_line")


@CORE.add("m10_consolidate")
def m10_consolidate(spark, sf_dir):
    """Clusters of automatic observations by the words of their texts."""
    o = observations(spark, sf_dir)
    v = enrich.embed(o.select("id", "content"), "id", "content", enrich.HashEmbedder())
    return memory.consolidate(o.join(v, "id"), dt.datetime(2024, 4, 1), threshold=0.8)


@CORE.add("n07_hash_embeddings")
def n07_hash_embeddings(spark, sf_dir):
    from codeweft.functions.text import embedding_text

    c = F.col
    s = symbols(spark, sf_dir).select("id", embedding_text(c("kind"), c("language"), c("name"), c("signature"), c("docstring"), c("body")).alias("text"))
    return enrich.embed(s, "id", "text", enrich.HashEmbedder())
