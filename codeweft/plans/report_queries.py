"""Queries of the statistics and memory operators over ``query_log``, ``observations``, ``symbols`` and ``files``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codeweft.functions import text as X
from codeweft.operators import graph, memory, stats, store
from codeweft.plans.sqltext import with_views
from codeweft.registry import CORE
from codeweft.sources.tables import nodes, observations, query_log, symbols, table

NOW = dt.datetime(2024, 9, 1)
_NOW = "TIMESTAMP '2024-09-01 00:00:00'"
_DAYS = 36_500
_LIVE = f"(expires_at IS NULL OR expires_at > {_NOW})"


def _log(spark, sf_dir, days=_DAYS):
    """The log up to :data:`NOW`, as the SQL states it."""
    return stats.since(query_log(spark, sf_dir), NOW, days).where(F.col("timestamp") <= F.lit(NOW))


_L = f"(SELECT * FROM qlog WHERE timestamp <= {_NOW} AND timestamp >= {_NOW} - INTERVAL {_DAYS} DAY)"


@CORE.add("a01_log_window", with_views(f"SELECT id, timestamp, task FROM qlog WHERE timestamp <= {_NOW} AND timestamp >= {_NOW} - INTERVAL 365 DAY"))
def a01_log_window(spark, sf_dir):
    return _log(spark, sf_dir, 365).select("id", "timestamp", "task")


@CORE.add(
    "a02_usage",
    with_views(
        f"""SELECT n_queries, tokens, candidate_tokens, greatest(candidate_tokens - tokens, 0) AS saved, CASE WHEN candidate_tokens > 0 THEN round(100.0 * greatest(candidate_tokens - tokens, 0) / candidate_tokens, 4) ELSE 0.0 END AS saved_pct,
        round(greatest(candidate_tokens - tokens, 0) * 3.0 / 1e6, 6) AS usd_saved FROM (SELECT count(*) AS n_queries, coalesce(sum(total_tokens), 0) AS tokens, coalesce(sum(candidate_file_tokens), 0) AS candidate_tokens FROM {_L})"""
    ),
)
def a02_usage(spark, sf_dir):
    return stats.usage(_log(spark, sf_dir))


@CORE.add("a03_latency", with_views(f"SELECT l[len(l) // 2 + 1] AS median, l[len(l) * 95 // 100 + 1] AS p95 FROM (SELECT list_sort(list(latency_ms)) AS l FROM {_L} WHERE latency_ms IS NOT NULL)"))
def a03_latency(spark, sf_dir):
    return stats.latency(_log(spark, sf_dir))


@CORE.add("a04_intents", with_views(f"SELECT coalesce(intent, 'unknown') AS intent, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {_L} GROUP BY 1"))
def a04_intents(spark, sf_dir):
    return stats.shares(_log(spark, sf_dir), "intent")


@CORE.add("a05_languages", with_views(f"SELECT trim(l) AS language, count(*) AS n FROM (SELECT unnest(languages_hit) AS l FROM {_L}) WHERE trim(l) <> '' GROUP BY 1"))
def a05_languages(spark, sf_dir):
    return stats.languages(_log(spark, sf_dir))


@CORE.add(
    "a06_workspace_savings",
    with_views(
        f"""SELECT avg_tokens, workspace_tokens, CASE WHEN workspace_tokens > 0 THEN round(100.0 * greatest(workspace_tokens - avg_tokens, 0) / workspace_tokens, 4) ELSE 0.0 END AS saved_pct
        FROM (SELECT CAST(sum(total_tokens) // count(*) AS BIGINT) AS avg_tokens FROM {_L}), (SELECT CAST(sum(length(body) // 4) AS BIGINT) AS workspace_tokens FROM sym)"""
    ),
)
def a06_workspace_savings(spark, sf_dir):
    return stats.workspace_savings(_log(spark, sf_dir), symbols(spark, sf_dir))


# the same reports over the whole log: later rows and rows without a time included
_WHOLE = {
    "a02_usage": lambda spark, sf_dir: stats.usage(query_log(spark, sf_dir)),
    "a03_latency": lambda spark, sf_dir: stats.latency(query_log(spark, sf_dir)),
    "a04_intents": lambda spark, sf_dir: stats.shares(query_log(spark, sf_dir), "intent"),
    "a05_languages": lambda spark, sf_dir: stats.languages(query_log(spark, sf_dir)),
    "a06_workspace_savings": lambda spark, sf_dir: stats.workspace_savings(query_log(spark, sf_dir), symbols(spark, sf_dir)),
}
for _name, _query in _WHOLE.items():
    CORE.add(f"{_name}_all", CORE.sql[_name].replace(_L, "qlog"))(_query)


@CORE.add(
    "a08_module_docs",
    with_views(
        """SELECT dir, count(*) AS n_symbols, coalesce(string_agg(line, chr(10) ORDER BY name, line) FILTER (kind IN ('class','interface','type_alias','enum','struct','trait')), '') AS types,
        coalesce(string_agg(line, chr(10) ORDER BY name, line) FILTER (kind IN ('function','async_function','method','async_method')), '') AS functions
        FROM (SELECT *, '- ' || name || CASE WHEN doc <> '' THEN ': ' || doc ELSE '' END AS line FROM (SELECT CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir, kind, coalesce(name, '') AS name,
            trim(string_split(coalesce(docstring, ''), chr(10))[1], ' ') AS doc FROM sym WHERE kind <> 'import')) GROUP BY dir HAVING count(*) >= 3"""
    ),
)
def a08_module_docs(spark, sf_dir):
    return stats.module_docs(symbols(spark, sf_dir))


@CORE.add(
    "a11_index_status",
    with_views(
        """SELECT (SELECT count(*) FROM sym) AS n_symbols, (SELECT count(*) FROM sym WHERE is_stub) AS n_stubs, (SELECT CAST(sum(length(body) // 4) AS BIGINT) FROM sym) AS workspace_tokens,
        (SELECT count(*) FROM link) AS n_edges, (SELECT count(*) FROM filestate) AS n_files, (SELECT count(*) FROM obs) AS n_observations"""
    ),
)
def a11_index_status(spark, sf_dir):
    link = graph.links(table(spark, sf_dir, "edges"), nodes(spark, sf_dir))
    files = table(spark, sf_dir, "files").where("path IS NOT NULL").select("path").distinct()
    return stats.index_status(symbols(spark, sf_dir), link, files, observations(spark, sf_dir))


@CORE.add("m04_mark_stale", with_views("""SELECT o.id, coalesce(o.is_stale, false) OR (o.symbol_hash IS NOT NULL AND o.symbol_fqn IN (SELECT fqn FROM sym WHERE fqn IS NOT NULL AND content_hash IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.fqn = o.symbol_fqn AND s.content_hash = lower(o.symbol_hash))) AS is_stale FROM obs o"""))
def m04_mark_stale(spark, sf_dir):
    return memory.mark_stale(observations(spark, sf_dir), symbols(spark, sf_dir)).select("id", "is_stale")


@CORE.add("m08_prune", with_views(f"SELECT id FROM obs WHERE expires_at <= {_NOW}"))
def m08_prune(spark, sf_dir):
    return memory.prune(observations(spark, sf_dir), NOW).select("id")


@CORE.add("a09_staleness", with_views(f"SELECT count(*) AS n_live, coalesce(round(100.0 * avg(CASE WHEN is_stale THEN 1 ELSE 0 END), 4), 0.0) AS stale_pct FROM obs WHERE {_LIVE}"))
def a09_staleness(spark, sf_dir):
    return memory.staleness(observations(spark, sf_dir), NOW)


_DUE = f"SELECT symbol_fqn, count(*) AS n FROM obs WHERE {_LIVE} AND symbol_fqn IS NOT NULL AND kind NOT IN ('summary', 'consolidated') GROUP BY 1 HAVING count(*) >= 3"


@CORE.add("a10_to_compress", with_views(_DUE))
def a10_to_compress(spark, sf_dir):
    return memory.to_compress(observations(spark, sf_dir), NOW)


@CORE.add(
    "m09_compress",
    with_views(
        f"""SELECT symbol_fqn, count(*) AS n, '[summary of ' || count(*) || ' observations] ' || coalesce(list(content ORDER BY created_at DESC, id DESC)[1], '') AS content, list(symbol_hash ORDER BY created_at DESC, id DESC)[1] AS symbol_hash
        FROM obs WHERE {_LIVE} AND symbol_fqn IS NOT NULL AND kind <> 'summary' AND symbol_fqn IN (SELECT symbol_fqn FROM ({_DUE})) GROUP BY 1 HAVING count(*) >= 3"""
    ),
)
def m09_compress(spark, sf_dir):
    return memory.compress(observations(spark, sf_dir), NOW)


@CORE.add("m12_recent", with_views(f"SELECT id, session_id, kind, created_at FROM obs WHERE {_LIVE} ORDER BY created_at DESC, id LIMIT 50"))
def m12_recent(spark, sf_dir):
    return memory.recent(observations(spark, sf_dir), NOW).select("id", "session_id", "kind", "created_at")


@CORE.add("m15_sessions", with_views(f"SELECT session_id, count(*) AS n, count(*) FILTER (is_stale) AS n_stale, max(created_at) AS last_at FROM obs WHERE {_LIVE} GROUP BY 1"))
def m15_sessions(spark, sf_dir):
    return memory.per_session(observations(spark, sf_dir), NOW)


_ASKED = ((1, "retry lock"), (2, "capsule budget tokens"), (3, "cache"))


@CORE.add(
    "m13_search",
    with_views(
        "SELECT query_id, place, id, score FROM (SELECT query_id, id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, max(created_at) DESC, id) AS place FROM (SELECT q.query_id, unnest(string_split(q.query, ' ')) AS word FROM (VALUES "
        + ", ".join(f"({i}, '{q}')" for i, q in _ASKED)
        + f") q(query_id, query)) w JOIN obs o ON contains(lower(coalesce(content, '')), word) OR contains(lower(coalesce(symbol_fqn, '')), word) WHERE {_LIVE} GROUP BY query_id, id) WHERE place <= 10"
    ),
)
def m13_search(spark, sf_dir):
    return memory.search(observations(spark, sf_dir), spark.createDataFrame(list(_ASKED), "query_id int, query string"), NOW)


@CORE.add(
    "m05_thrash",
    """SELECT path, ts, n FROM (SELECT CAST(user_id AS VARCHAR) AS path, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW) AS n
    FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) WHERE n >= 4""",
)
def m05_thrash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return memory.thrash(e, seconds=6 * 3600)


@CORE.add(
    "m06_dead_ends",
    """SELECT session_id, fqn, added_at, min(ts) AS removed_at FROM (SELECT a.session_id, a.fqn, a.added_at, r.ts FROM (SELECT user_id AS session_id, event_type AS fqn, min(ts) AS added_at FROM
    (SELECT user_id, json_extract_string(props, '$.k') AS event_type, ts FROM events WHERE event_type = 'signup') GROUP BY 1, 2) a JOIN (SELECT user_id, json_extract_string(props, '$.k') AS k, ts FROM events WHERE event_type = 'error') r
    ON r.user_id = a.session_id AND r.k = a.fqn AND r.ts > a.added_at) GROUP BY 1, 2, 3""",
)
def m06_dead_ends(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    action = F.when(F.col("event_type") == "signup", "add").otherwise("remove")
    return memory.dead_ends(e.select(F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("fqn"), action.alias("action"), "ts"))


@CORE.add(
    "m07_suppress_repeats",
    with_views(
        """WITH RECURSIVE runs AS (SELECT task, id, timestamp AS t, row_number() OVER (PARTITION BY task ORDER BY timestamp, id) AS rn FROM qlog WHERE task IS NOT NULL AND timestamp IS NOT NULL),
        fold(task, id, rn, last, kept) AS (SELECT task, id, rn, t, true FROM runs WHERE rn = 1 UNION ALL SELECT r.task, r.id, r.rn, CASE WHEN r.t - f.last >= INTERVAL 30 MINUTE THEN r.t ELSE f.last END, r.t - f.last >= INTERVAL 30 MINUTE
        FROM fold f JOIN runs r ON r.task = f.task AND r.rn = f.rn + 1) SELECT task, id FROM fold WHERE kept"""
    ),
)
def m07_suppress_repeats(spark, sf_dir):
    return memory.suppress_repeats(query_log(spark, sf_dir))


_OLD = "old AS (SELECT id, fqn, file_path, kind, CASE WHEN id % 7 = 1 THEN '~' || coalesce(signature, '') ELSE signature END AS signature, CASE WHEN id % 7 = 2 THEN '~' || coalesce(body, '') ELSE body END AS body FROM sym WHERE id % 7 <> 3)"
_NEW = "new AS (SELECT id, fqn, file_path, kind, signature, body FROM sym WHERE id % 7 <> 4)"
_DIFF = f"""{_OLD}, {_NEW}, o AS (SELECT * FROM old WHERE fqn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY id DESC) = 1), n AS (SELECT * FROM new WHERE fqn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY id DESC) = 1),
    diff AS (SELECT * FROM (SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.fqn, o.fqn) AS fqn, CASE WHEN o.fqn IS NULL AND n.kind = 'import' THEN 'dependency_added' WHEN o.fqn IS NULL THEN 'new_symbol' WHEN n.fqn IS NULL THEN 'deleted_symbol'
        WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature_change' WHEN o.body IS DISTINCT FROM n.body THEN 'body_change' END AS category FROM o FULL OUTER JOIN n ON o.fqn = n.fqn) WHERE category IS NOT NULL)"""


def _two_states(spark, sf_dir):
    """Two states of the symbol table: every row is in one or both, some with another signature or body."""
    s = symbols(spark, sf_dir).select("id", "fqn", "file_path", "kind", "signature", "body")
    r = F.col("id") % 7
    old = s.where(r != 3).withColumns({"signature": F.when(r == 1, F.concat(F.lit("~"), F.coalesce("signature", F.lit("")))).otherwise(F.col("signature")), "body": F.when(r == 2, F.concat(F.lit("~"), F.coalesce("body", F.lit("")))).otherwise(F.col("body"))})
    return old, s.where(r != 4)


@CORE.add("m02_symbol_diff", with_views(f"WITH {_DIFF} SELECT file_path, fqn, category FROM diff"))
def m02_symbol_diff(spark, sf_dir):
    return memory.symbol_diff(*_two_states(spark, sf_dir))


@CORE.add(
    "m03_passive_notes",
    with_views(
        f"""WITH {_DIFF}, c AS (SELECT file_path, category, count(*) AS n, list(fqn ORDER BY fqn) AS names, CASE category WHEN 'new_symbol' THEN 0 WHEN 'deleted_symbol' THEN 1 WHEN 'signature_change' THEN 2 WHEN 'dependency_added' THEN 3 ELSE 4 END AS w FROM diff GROUP BY 1, 2)
        SELECT file_path, category, n, category || ' in ' || file_path || ': ' || CASE WHEN n <= 3 THEN array_to_string(names, ', ') ELSE names[1] || ', ' || names[2] || ', … (' || n || ' total)' END AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY w) AS rn FROM c) WHERE rn = 1"""
    ),
)
def m03_passive_notes(spark, sf_dir):
    return memory.passive_notes(memory.symbol_diff(*_two_states(spark, sf_dir)))


@CORE.add("m01_ttl", with_views("""SELECT id, CASE WHEN kind IN ('passive','dead_end','file_thrash','auto') THEN created_at + INTERVAL 7 DAY WHEN kind IN ('manual','insight') THEN NULL ELSE created_at + INTERVAL 90 DAY END AS expires_at FROM obs"""))
def m01_ttl(spark, sf_dir):
    return memory.with_ttl(observations(spark, sf_dir)).select("id", "expires_at")


@CORE.add("c05_session_lines", with_views("""SELECT id, '[' || coalesce(kind, 'manual') || '] ' || coalesce(content, '') || CASE WHEN is_stale THEN ' [stale]' ELSE '' END || CASE WHEN symbol_fqn IS NOT NULL THEN ' @ ' || symbol_fqn ELSE '' END AS line FROM obs"""))
def c05_session_lines(spark, sf_dir):
    return memory.session_lines(observations(spark, sf_dir), "L3")


_WHEN = " ".join(f"WHEN {' OR '.join(f"contains(lower(task), '{w}')" for w in words)} THEN '{name}'" for name, words in X.INTENT_WORDS)


@CORE.add("r01_intent", with_views(f"SELECT id, CASE {_WHEN} ELSE 'general' END AS intent FROM qlog WHERE task IS NOT NULL"))
def r01_intent(spark, sf_dir):
    return query_log(spark, sf_dir).where("task IS NOT NULL").select("id", X.intent(F.col("task")).alias("intent"))


@CORE.add("r08_query_terms", with_views("SELECT id, len(list_filter(regexp_split_to_array(lower(task), '[^\\p{L}\\p{N}]+'), lambda x: octet_length(encode(x)) >= 3)) AS n_terms FROM qlog WHERE task IS NOT NULL"))
def r08_query_terms(spark, sf_dir):
    return query_log(spark, sf_dir).where("task IS NOT NULL").select("id", F.size(X.query_terms(F.col("task"))).alias("n_terms"))


_SYMBOL_FLAGS = """SELECT id, octet_length(encode(coalesce(body, ''))) // 4 AS tokens, coalesce(octet_length(encode(CASE WHEN docstring IS NOT NULL THEN docstring || chr(10) || coalesce(signature, '') ELSE coalesce(signature, '') END)) // 4, 0) AS skeleton_tokens,
    regexp_matches(lower(file_path), 'test|spec|mock') AS test_path, regexp_matches(file_path, '/test|_test\\.|test_|/spec|_spec\\.') AS test_file, regexp_matches(regexp_extract(file_path, '[^/]*$'), '^(check-|run-|setup|generate|gen-|build-|deploy-)') AS utility,
    NOT is_stub AND kind <> 'import' AND NOT (kind IN ('class','interface','type_alias','enum','struct','trait') AND regexp_matches(name, '(Error|Exception|Warning)$') AND len(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: trim(x, ' ') <> '')) <= 3 AND NOT is_stub) AS eligible
    FROM sym WHERE kind IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL"""


@CORE.add("f_symbol_flags", with_views(_SYMBOL_FLAGS))
def f_symbol_flags(spark, sf_dir):
    """F2-F6 and X10 on every symbol."""
    c = F.col
    s = symbols(spark, sf_dir).where("kind IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL")
    return s.select(
        "id", X.tokens(c("body")).alias("tokens"), X.skeleton_tokens(c("docstring"), c("signature")).alias("skeleton_tokens"), X.is_test_path(c("file_path")).alias("test_path"), X.is_test_file(c("file_path")).alias("test_file"), X.is_utility(c("file_path")).alias("utility"),
        X.pivot_eligible(c("kind"), c("name"), c("body"), c("is_stub")).alias("eligible"),
    )


@CORE.add("s02_stub_files", with_views("SELECT file_path, count(*) AS n_symbols FROM sym WHERE is_stub GROUP BY 1"))
def s02_stub_files(spark, sf_dir):
    return symbols(spark, sf_dir).where("is_stub").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))


@CORE.add("s03_sensitive_names", """SELECT DISTINCT path FROM (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS n FROM files WHERE path IS NOT NULL) WHERE starts_with(n, '.env') OR ends_with(n, '.env') OR regexp_matches(n, 'secret|credential|password') OR regexp_matches(n, '\\.(pem|key|p12|pfx)$')""")
def s03_sensitive_names(spark, sf_dir):
    return table(spark, sf_dir, "files").where(X.sensitive_name(F.col("path"))).select("path").distinct()


_KEYS = "|".join(f"{p}[A-Za-z0-9_/-]{{{n},}}" for p, n in X.KEY_PREFIXES)


@CORE.add("s04_texts_with_keys", f"SELECT doc_id, coalesce(regexp_matches(text, '{_KEYS}'), false) AS holds_key FROM documents")
def s04_texts_with_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.holds_key(F.col("text")).alias("holds_key"))


_EXT = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in X.EXTENSIONS.items()) + " END"


@CORE.add("s05_languages_of_files", f"SELECT {_EXT} AS language, count(DISTINCT path) AS n_files FROM files WHERE path IS NOT NULL GROUP BY 1")
def s05_languages_of_files(spark, sf_dir):
    return table(spark, sf_dir, "files").where("path IS NOT NULL").groupBy(X.language_of(F.col("path")).alias("language")).agg(F.countDistinct("path").alias("n_files"))


@CORE.add("s06_hash_mismatch", with_views("SELECT id FROM sym WHERE body IS NOT NULL AND content_hash IS NOT NULL AND sha256(body) <> content_hash"))
def s06_hash_mismatch(spark, sf_dir):
    return symbols(spark, sf_dir).where(F.sha2("body", 256) != F.col("content_hash")).select("id")


_FIRST = "SELECT path, content_hash FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at, content_hash NULLS FIRST) = 1"


@CORE.add("s07_changed_files", with_views(f"SELECT f.path, f.content_hash FROM filestate f JOIN ({_FIRST}) o USING (path) WHERE o.content_hash IS NULL OR f.content_hash IS NULL OR o.content_hash <> f.content_hash"))
def s07_changed_files(spark, sf_dir):
    """Files whose latest state differs from the first one, or cannot be compared: what an incremental run reads again."""
    f = table(spark, sf_dir, "files").where("path IS NOT NULL")
    g = f.groupBy("path").agg(F.max_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"), F.min_by("content_hash", F.struct("indexed_at", "content_hash")).alias("was"))
    return store.to_read(g.select("path", "content_hash"), g.select("path", F.col("was").alias("content_hash"))).select("path", "content_hash")


@CORE.add("s08_stale_paths", with_views("SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND path NOT IN (SELECT file_path FROM sym WHERE file_path IS NOT NULL)"))
def s08_stale_paths(spark, sf_dir):
    return store.gone(symbols(spark, sf_dir).select(F.col("file_path").alias("path")), table(spark, sf_dir, "files").where("path IS NOT NULL"))


@CORE.add("s09_latest_files", with_views("SELECT path, content_hash, indexed_at FROM filestate"))
def s09_latest_files(spark, sf_dir):
    """The state of every file after all its states were put in, the first ones and then the last ones."""
    f = table(spark, sf_dir, "files").where("path IS NOT NULL")
    state = lambda pick: f.groupBy("path").agg(pick(F.struct("indexed_at", "content_hash")).alias("s")).select("path", "s.content_hash", "s.indexed_at")
    return store.upsert(state(F.min), state(F.max), ["path"])


@CORE.add("s10_leaf_lookup", with_views("SELECT leaf_name, id, place FROM (SELECT leaf_name, id, row_number() OVER (PARTITION BY leaf_name ORDER BY id) AS place FROM sym WHERE leaf_name IS NOT NULL) WHERE place <= 5"))
def s10_leaf_lookup(spark, sf_dir):
    """The first five symbols of every leaf name."""
    s = symbols(spark, sf_dir).where("leaf_name IS NOT NULL")
    return store.by_leaf(s, s)


@CORE.add("s11_cascade", with_views("SELECT from_id, to_id, kind FROM link WHERE from_id NOT IN (SELECT id FROM sym WHERE is_stub) AND to_id NOT IN (SELECT id FROM sym WHERE is_stub)"))
def s11_cascade(spark, sf_dir):
    """The links that remain when all stub files are removed."""
    gone = symbols(spark, sf_dir).where("is_stub").select("id")
    link = graph.links(table(spark, sf_dir, "edges"), nodes(spark, sf_dir))
    return store.edges_without(link, gone).select("from_id", "to_id", "kind")


@CORE.add("s13_language_counts", with_views("SELECT language, count(*) AS n_symbols, CAST(sum(octet_length(encode(coalesce(body, ''))) // 4) AS BIGINT) AS tokens FROM sym GROUP BY 1"))
def s13_language_counts(spark, sf_dir):
    return symbols(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum(X.tokens(F.col("body"))).alias("tokens"))


_LSP = "lsp AS (SELECT DISTINCT f.fqn AS from_fqn, coalesce(t.fqn, 'missing::' || k.to_id) AS to_fqn, k.kind FROM kinded k JOIN sym f ON f.id = k.from_id LEFT JOIN node t ON t.id = k.to_id WHERE k.kind = 'inherits')"


@CORE.add(
    "s14_pushed_edges",
    with_views(
        f"""WITH {_LSP}, u AS (SELECT fqn, min(id) AS id FROM node WHERE fqn IS NOT NULL GROUP BY 1), r AS (SELECT l.*, a.id AS from_id, b.id AS to_id FROM lsp l LEFT JOIN u a ON a.fqn = l.from_fqn LEFT JOIN u b ON b.fqn = l.to_fqn)
        SELECT count(*) FILTER (from_id IS NOT NULL AND to_id IS NOT NULL) AS n_accepted, count(*) FILTER (from_id IS NULL OR to_id IS NULL) AS n_skipped FROM r"""
    ),
)
def s14_pushed_edges(spark, sf_dir):
    """Inheritance edges pushed by name: how many are accepted and skipped."""
    n = nodes(spark, sf_dir)
    e = table(spark, sf_dir, "edges").where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id", graph.known_kind(F.col("kind")).alias("kind")).where("kind = 'inherits'")
    src = symbols(spark, sf_dir).select(F.col("id").alias("from_id"), F.col("fqn").alias("from_fqn"))
    dst = n.select(F.col("id").alias("to_id"), F.col("fqn").alias("to_fqn"))
    pushed = e.join(src, "from_id").join(dst, "to_id", "left").select("from_fqn", F.coalesce("to_fqn", F.concat(F.lit("missing::"), F.col("to_id").cast("string"))).alias("to_fqn"), "kind").distinct()
    ok = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    return store.resolve_pushed(pushed, n).agg(F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("n_accepted"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("n_skipped"))


@CORE.add(
    "s15_store_check",
    """SELECT s.store_id, s.dim, s.count AS n_header, coalesce(h.n, 0) AS n_held, coalesce(h.n_fit, 0) AS n_fit, s.magic = 'CSEMB001' AND s.dim BETWEEN 1 AND 16384 AND s.count = coalesce(h.n_fit, 0) AS valid FROM embedding_store s
    LEFT JOIN (SELECT e.store_id, count(*) AS n, count(*) FILTER (len(embedding) = dim) AS n_fit FROM (SELECT DISTINCT symbol_id, store_id, embedding FROM symbol_embeddings) e JOIN embedding_store USING (store_id) GROUP BY 1) h USING (store_id)""",
)
def s15_store_check(spark, sf_dir):
    """What the header of each vector store says against what the store holds."""
    st = table(spark, sf_dir, "embedding_store")
    e = table(spark, sf_dir, "symbol_embeddings").distinct().join(st.select("store_id", "dim"), "store_id")
    held = e.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_held"), F.sum((F.size("embedding") == F.col("dim")).cast("long")).alias("n_fit"))
    j = st.join(held, "store_id", "left").na.fill(0, ["n_held", "n_fit"])
    return j.select("store_id", "dim", F.col("count").alias("n_header"), "n_held", "n_fit", ((F.col("magic") == "CSEMB001") & F.col("dim").between(1, 16384) & (F.col("count") == F.col("n_fit"))).alias("valid"))


@CORE.add("s16_manifest", with_views("""SELECT string_split(path, '/')[1] AS workspace, count(*) AS n_files, '{' || string_agg('"' || path || '":"' || content_hash || '"', ',' ORDER BY path) || '}' AS manifest FROM filestate WHERE content_hash IS NOT NULL GROUP BY 1"""))
def s16_manifest(spark, sf_dir):
    """The manifest of every workspace as JSON, paths in order."""
    f = s09_latest_files(spark, sf_dir).where("content_hash IS NOT NULL")
    pairs = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    return f.groupBy(F.substring_index("path", "/", 1).alias("workspace")).agg(F.count(F.lit(1)).alias("n_files"), F.to_json(F.map_from_entries(pairs)).alias("manifest"))


@CORE.add("s22_leaf_backfill", with_views("SELECT id, string_split(name, '::')[-1] AS leaf FROM sym WHERE name IS NOT NULL AND leaf_name IS DISTINCT FROM string_split(name, '::')[-1]"))
def s22_leaf_backfill(spark, sf_dir):
    """Rows whose stored leaf name is not the last part of their name."""
    return symbols(spark, sf_dir).where("name IS NOT NULL").select("id", X.leaf(F.col("name")).alias("leaf"), "leaf_name").where(~F.col("leaf_name").eqNullSafe(F.col("leaf"))).select("id", "leaf")


