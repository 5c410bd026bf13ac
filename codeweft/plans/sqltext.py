"""Named SQL views that the SQL forms of the queries share."""

from __future__ import annotations

import re

VIEWS = {
    "sym": """SELECT id, fqn, name, leaf_name, CASE lower(trim(kind)) WHEN 'fn' THEN 'function' WHEN 'async fn' THEN 'async_function' WHEN 'type' THEN 'type_alias'
        WHEN 'mod' THEN 'module' WHEN 'const' THEN 'constant' WHEN 'var' THEN 'variable' WHEN 'async method' THEN 'async_method' WHEN 'script' THEN 'script_block'
        WHEN 'style' THEN 'style_block' ELSE lower(trim(kind)) END AS kind, file_path, start_line, end_line, signature, docstring, body, lower(trim(language)) AS language,
        lower(content_hash) AS content_hash, coalesce(is_stub, false) AS is_stub, source, resolved_type
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn_ FROM symbols WHERE id IS NOT NULL) WHERE rn_ = 1""",
    "node": """SELECT id, fqn, name, kind, file_path, is_stub FROM sym UNION ALL
        SELECT id, fqn, name, kind, file_path, coalesce(is_stub, false) FROM library_symbols WHERE id NOT IN (SELECT id FROM sym)""",
    "kinded": """SELECT from_id, to_id, k AS kind, CASE k WHEN 'imports' THEN 1 WHEN 'implements' THEN 2 WHEN 'calls' THEN 3 WHEN 'references' THEN 4 WHEN 'inherits' THEN 5 ELSE 6 END AS ord FROM (
        SELECT from_id, to_id, CASE WHEN lower(trim(kind)) IN ('imports','calls','implements','inherits','references','defined_in') THEN lower(trim(kind)) ELSE 'references' END AS k
        FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL)""",
    "link": """SELECT from_id, to_id, arg_min(kind, ord) AS kind FROM kinded WHERE from_id <> to_id AND from_id IN (SELECT id FROM node) AND to_id IN (SELECT id FROM node) GROUP BY 1, 2""",
    "deg": """SELECT n.id, coalesce(i.c, 0) AS n_in, coalesce(o.c, 0) AS n_out, 2 * coalesce(i.c, 0) + coalesce(o.c, 0) AS raw FROM node n
        LEFT JOIN (SELECT to_id AS id, count(*) AS c FROM link GROUP BY 1) i USING (id) LEFT JOIN (SELECT from_id AS id, count(*) AS c FROM link GROUP BY 1) o USING (id)""",
    "kval": """SELECT CAST(greatest(raw, 1) AS DOUBLE) AS k FROM (SELECT raw, row_number() OVER (ORDER BY raw) AS rn, count(*) OVER () AS n FROM deg)
        WHERE rn = CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1""",
    "cent": "SELECT id, n_in, n_out, raw, raw / (raw + k) AS centrality FROM deg, kval",
    "obs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn_ FROM observations WHERE id IS NOT NULL) WHERE rn_ = 1""",
    "qlog": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp DESC) AS rn_ FROM query_log WHERE id IS NOT NULL) WHERE rn_ = 1""",
    "filestate": """SELECT path, content_hash, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, content_hash DESC NULLS LAST) AS rn_ FROM files
        WHERE path IS NOT NULL) WHERE rn_ = 1""",
}


def with_views(body: str, recursive: bool = False) -> str:
    """``body`` with the views that it names, and those that they name, in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(body)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {text[15:]}" if head else text
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}" if head else text
    return f"WITH {head} {text}" if head else text
