"""Operators over small fixed tables, for behaviour that the test tables have no rows for; the SQL states what must come out.

Texts, graphs and workspaces here are invented; each holds the cases that an operator decides about.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codeweft.functions import anchors as A
from codeweft.functions import text as X
from codeweft.operators import bm25, capsule, diff, edges, enrich, graph, memory, ranking, store
from codeweft.plans import pipeline
from codeweft.registry import CORE
from codeweft.sources import extract as P

NOW = dt.datetime(2024, 9, 1)
_SYMBOL = ("id", "fqn", "kind", "language", "file_path", "start_line", "end_line", "signature", "docstring", "body", "is_stub")
_SCHEMA = "id long, fqn string, kind string, language string, file_path string, start_line int, end_line int, signature string, docstring string, body string, is_stub boolean"


def table_of(spark, rows: list[dict]):
    """Symbols from what matters of them; names follow from the fqn, which begins with the path."""
    full = [{"kind": "function", "language": "python", "start_line": 1, "end_line": 1, "is_stub": False} | r for r in rows]
    df = spark.createDataFrame([tuple(r.get(c) for c in _SYMBOL) for r in full], _SCHEMA)
    name = F.when(F.col("fqn").contains("/") | F.col("fqn").rlike(r"\.\w+::"), F.regexp_replace("fqn", r"^.*?\.\w+::", "")).otherwise(F.col("fqn"))
    return df.withColumns({"name": name, "leaf_name": F.element_at(F.split(name, "::"), -1), "source": F.lit(None).cast("string"), "resolved_type": F.lit(None).cast("string"), "content_hash": F.sha2("body", 256)})


def _one(spark, *texts: str, name: str = "task"):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], f"query_id long, {name} string")


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


def _joined(c):
    return F.array_join(c, " ")


# ---- sources and store ------------------------------------------------------------------------------------------------


@CORE.add("s03_cases", values("path, secret", "('.env', true)", "('conf/.env.local', true)", "('a/Secret_store.py', true)", "('keys/id.pem', true)", "('x/password.txt', true)", "('a/prod.env', true)", "('my.credentials.json', true)", "('src/main.py', false)", "('env.py', false)", "('secret/plain.py', false)"))
def s03_cases(spark, sf_dir):
    """Names of files that are not read; the folder does not matter."""
    paths = [".env", "conf/.env.local", "a/Secret_store.py", "keys/id.pem", "x/password.txt", "a/prod.env", "my.credentials.json", "src/main.py", "env.py", "secret/plain.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", X.sensitive_name(F.col("path")).alias("secret"))


@CORE.add("s06_cases", "SELECT id, sha256(body) AS content_hash FROM (VALUES (1, 'abc'), (2, ''), (3, 'ä\u00a0日本')) AS t(id, body) UNION ALL SELECT 4, NULL")
def s06_cases(spark, sf_dir):
    """The hash of a body is that of its bytes."""
    s = table_of(spark, [{"id": 1, "body": "abc"}, {"id": 2, "body": ""}, {"id": 3, "body": "ä\u00a0日本"}, {"id": 4, "body": None}])
    return s.select(F.col("id").cast("int").alias("id"), "content_hash")


@CORE.add("s08_cases", values("path", "('gone.py')", "('old/b.py')"))
def s08_cases(spark, sf_dir):
    """Tracked paths, some twice, that the scan does not find."""
    scan = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "path string, content_hash string")
    tracked = spark.createDataFrame([("a.py", "0"), ("gone.py", "1"), ("gone.py", "2"), ("old/b.py", None)], "path string, content_hash string")
    return store.gone(scan, tracked)


@CORE.add("s09_cases", values("id, v, how", "(1, 'new', 'last')", "(2, 'old', 'last')", "(3, 'new', 'last')", "(1, 'old', 'first')", "(2, 'old', 'first')", "(3, 'new', 'first')"))
def s09_cases(spark, sf_dir):
    """Upserts where the last row wins, and where the first does."""
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "new"), (3, "new")], "id int, v string")
    put = lambda first: store.upsert(old, new, ["id"], first).withColumn("how", F.lit("first" if first else "last"))
    return put(False).unionByName(put(True))


@CORE.add("s11_cases", values("part, key", "('symbols', '3')", "('edges', '3>3')", "('embeddings', '3')", "('files', 'keep.py')"))
def s11_cases(spark, sf_dir):
    """What is left of four tables when a file goes with all that belongs to it."""
    s = table_of(spark, [{"id": 1, "fqn": "a", "file_path": "gone.py"}, {"id": 2, "fqn": "b", "file_path": "gone.py"}, {"id": 3, "fqn": "c", "file_path": "keep.py"}])
    e = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (3, 3)], "from_id long, to_id long")
    v = spark.createDataFrame([(1,), (3,)], "symbol_id long")
    f = spark.createDataFrame([("gone.py",), ("keep.py",)], "path string")
    a, b, c, d = store.cascade(f.where("path = 'gone.py'"), s, e, v, f)
    show = lambda df, part, key: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"))
    return show(a, "symbols", F.col("id")).unionByName(show(b, "edges", F.concat_ws(">", "from_id", "to_id"))).unionByName(show(c, "embeddings", F.col("symbol_id"))).unionByName(show(d, "files", F.col("path")))


@CORE.add("s22_cases", values("name, leaf", "('a::b::c', 'c')", "('hist', 'hist')", "('A::', '')", "('', '')"))
def s22_cases(spark, sf_dir):
    return spark.createDataFrame([("a::b::c",), ("hist",), ("A::",), ("",)], "name string").select("name", X.leaf(F.col("name")).alias("leaf"))


# ---- extraction -------------------------------------------------------------------------------------------------------

_SOURCES = {
    "greet.py": 'import os\nfrom a.b import validate, parse_request as pr\n\n\n@deco\nclass Foo(pkg.Base):\n    """A foo."""\n\n    def __init__(self, x):\n        self.x = x\n\n    async def bar(self) -> str:\n        return "a"\n\n\ndef greet(name: str) -> str:\n    """Say hello."""\n    return f"hello {name}"\n',
    "app.ts": "import { A, B as C } from './m';\n\nexport interface Shape {\n  area(): number;\n}\n\n/** Adds. */\nexport function add(a: number, b: number): number {\n  return a + b;\n}\n\nexport class Box {\n  size(): number {\n    return 1;\n  }\n}\n",
    "lib.rs": "use crate::m::{X, Y};\n\n/// A token.\npub struct UserToken {\n    id: u64,\n}\n\nimpl Display for UserToken {\n    fn fmt(&self) -> String {\n        String::new()\n    }\n}\n\npub fn validate_token(token: UserToken) -> bool {\n    true\n}\n",
    "run.sh": "#!/bin/bash\nfoo() {\n  bar 1\n  baz | bar\n}\n\nfunction bar {\n  echo hi\n}\n",
    "db.sql": "CREATE TABLE users (id INT);\n\nCREATE VIEW active AS\nSELECT * FROM users WHERE id > 0;\n",
    "doc.md": "# Title\n\nText.\n\n## Part one\n\nMore.\n\nSecond\n------\n\nEnd.\n",
    "view.swift": "import Foundation\n\nclass Lamp {\n    func glow(level: Int) -> Bool {\n        return true\n    }\n}\n\nfunc start() {\n}\n",
    "empty.py": "",
}


def _extracted(spark):
    return P.extract(spark.createDataFrame(list(_SOURCES.items()), "path string, content string"))


_FOUND = [
    ("greet.py", "class", "Foo"), ("greet.py", "method", "Foo::__init__"), ("greet.py", "async_method", "Foo::bar"), ("greet.py", "function", "greet"), ("app.ts", "interface", "Shape"), ("app.ts", "function", "add"),
    ("app.ts", "class", "Box"), ("app.ts", "method", "Box::size"), ("lib.rs", "struct", "UserToken"), ("lib.rs", "function", "UserToken::fmt"), ("lib.rs", "function", "validate_token"), ("run.sh", "function", "foo"), ("run.sh", "function", "bar"),
    ("db.sql", "struct", "users"), ("db.sql", "type_alias", "active"), ("doc.md", "module", "Title"), ("doc.md", "module", "Part one"), ("doc.md", "module", "Second"), ("view.swift", "class", "Lamp"), ("view.swift", "method", "Lamp::glow"), ("view.swift", "function", "start"),
]


@CORE.add("xp_cases", values("file_path, kind, name", *[f"('{p}', '{k}', '{n}')" for p, k, n in _FOUND]))
def xp_cases(spark, sf_dir):
    """The declarations of a small file in each language; imports and implementations are in the other cases."""
    return _extracted(spark).where("kind NOT IN ('import', 'impl')").select("file_path", "kind", "name")


@CORE.add("xp_details_cases", values("name, docstring, start_line, end_line", "('greet', 'Say hello.', 16, 18)", "('Foo', 'A foo.', 5, 13)", "('add', 'Adds.', 8, 10)", "('UserToken', 'A token.', 4, 6)"))
def xp_details_cases(spark, sf_dir):
    """Documentation and lines of some of them."""
    x = _extracted(spark).where("name IN ('greet', 'Foo', 'add', 'UserToken')")
    return x.select("name", F.trim(F.regexp_replace("docstring", r"^[/*\s]+|[*/\s]+$", "")).alias("docstring"), "start_line", "end_line")


# ---- edges ------------------------------------------------------------------------------------------------------------


def _named(spark, df, kind: str):
    s = _names_of(spark)
    a, b = s.select(F.col("id").alias("from_id"), F.col("fqn").alias("f")), s.select(F.col("id").alias("to_id"), F.col("fqn").alias("t"))
    return df.where(F.col("kind") == kind).join(a, "from_id").join(b, "to_id").select("f", "t")


_GRAPH = [
    {"id": 1, "fqn": "m.py::import a", "kind": "import", "file_path": "m.py", "body": "from a.b import validate, parse_request as pr"},
    {"id": 2, "fqn": "b.py::validate", "file_path": "b.py", "body": "def validate(x):\n    return parse_request(x)"},
    {"id": 3, "fqn": "b.py::parse_request", "file_path": "b.py", "body": "def parse_request(x):\n    return x"},
    {"id": 4, "fqn": "t.ts::import x", "kind": "import", "language": "typescript", "file_path": "t.ts", "body": 'import Def, { Shape, type Box as B } from "./x";'},
    {"id": 5, "fqn": "x.ts::Shape", "kind": "interface", "language": "typescript", "file_path": "x.ts", "body": "interface Shape {}"},
    {"id": 6, "fqn": "x.ts::Box", "kind": "class", "language": "typescript", "file_path": "x.ts", "body": "class Box {}"},
    {"id": 7, "fqn": "l.rs::use", "kind": "import", "language": "rust", "file_path": "l.rs", "body": "use crate::m::{UserToken, Display};"},
    {"id": 8, "fqn": "l.rs::UserToken", "kind": "struct", "language": "rust", "file_path": "l.rs", "body": "pub struct UserToken;"},
    {"id": 9, "fqn": "l.rs::Display", "kind": "trait", "language": "rust", "file_path": "l.rs", "body": "pub trait Display {}"},
    {"id": 10, "fqn": "l.rs::impl::Display for UserToken<T>", "kind": "impl", "language": "rust", "file_path": "l.rs", "body": "impl Display for UserToken<T> {}"},
    {"id": 11, "fqn": "l.rs::validate_token", "language": "rust", "file_path": "l.rs", "body": "fn validate_token(token: UserToken) -> bool {\n    Shape::of(token);\n    missing_one(2)\n}"},
    {"id": 12, "fqn": "r.sh::foo", "language": "shell", "file_path": "r.sh", "body": "foo() {\n  bar 1\n  x=$(baz) | bar\n  foo\n  echo qux\n}"},
    {"id": 13, "fqn": "r.sh::bar", "language": "shell", "file_path": "r.sh", "body": "bar() {\n  qux;\n}"},
    {"id": 14, "fqn": "r.sh::baz", "language": "shell", "file_path": "r.sh", "body": "baz() { :; }"},
    {"id": 15, "fqn": "r.sh::qux", "language": "shell", "file_path": "r.sh", "body": "qux() { :; }"},
    {"id": 16, "fqn": "d.sql::users", "kind": "struct", "language": "sql", "file_path": "d.sql", "body": "CREATE TABLE users (id INT)"},
    {"id": 17, "fqn": "d.sql::active", "kind": "type_alias", "language": "sql", "file_path": "d.sql", "body": "CREATE VIEW active AS SELECT * FROM app.Users u JOIN roles r"},
    {"id": 18, "fqn": "d.sql::purge", "language": "sql", "file_path": "d.sql", "body": "CREATE FUNCTION purge() AS $$ update users set x = 1; select 1 from active; $$"},
    {"id": 19, "fqn": "d.py::doc", "file_path": "d.py", "body": 'def doc():\n    """\n    >>> validate(1)\n    """\n    return parse_request(2)'},
]


def _names_of(spark):
    return table_of(spark, _GRAPH)


@CORE.add("e01_cases", values("f, t", "('m.py::import a', 'b.py::validate')", "('m.py::import a', 'b.py::parse_request')", "('t.ts::import x', 'x.ts::Shape')", "('t.ts::import x', 'x.ts::Box')", "('l.rs::use', 'l.rs::UserToken')", "('l.rs::use', 'l.rs::Display')"))
def e01_cases(spark, sf_dir):
    return _named(spark, edges.imports(_names_of(spark)), "imports")


@CORE.add("e02_cases", values("f, t", "('l.rs::UserToken', 'l.rs::Display')"))
def e02_cases(spark, sf_dir):
    return _named(spark, edges.implements(_names_of(spark)), "implements")


@CORE.add("e03_cases", values("from_id, to_id, label", "(2, 3, 'parse_request(x)')", "(19, 3, 'parse_request(2)')"))
def e03_cases(spark, sf_dir):
    """Calls with their labels; what stands in a documentation string is no call, and nothing calls itself."""
    ids = F.col("from_id").isin(2, 3, 11, 19)
    return edges.calls(_names_of(spark)).where(ids).select(F.col("from_id").cast("int").alias("from_id"), F.col("to_id").cast("int").alias("to_id"), "label")


@CORE.add("e04_cases", values("f, t", "('l.rs::validate_token', 'l.rs::UserToken')"))
def e04_cases(spark, sf_dir):
    return _named(spark, edges.references(_names_of(spark).where("language = 'rust'")), "references")


@CORE.add("e05_cases", values("f, t", "('r.sh::foo', 'r.sh::bar')", "('r.sh::foo', 'r.sh::baz')", "('r.sh::bar', 'r.sh::qux')"))
def e05_cases(spark, sf_dir):
    return _named(spark, edges.shell_calls(_names_of(spark)), "calls")


@CORE.add("e06_cases", values("f, t", "('d.sql::active', 'd.sql::users')", "('d.sql::purge', 'd.sql::users')", "('d.sql::purge', 'd.sql::active')"))
def e06_cases(spark, sf_dir):
    return _named(spark, edges.sql_references(_names_of(spark)), "references")


# ---- graph ------------------------------------------------------------------------------------------------------------


@CORE.add("g05_cases", values("from_id, to_id, path", f"(0, 20, '{' '.join(map(str, range(21)))}')", "(0, 32, '0 30 32')", "(5, 5, '5')", "(1, 3, '1 2 3')"))
def g05_cases(spark, sf_dir):
    """A path of twenty steps, the one through the smaller ids of two equal ones, a node to itself; what cannot be reached is absent."""
    link = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 31), (31, 32), (0, 30), (30, 32)], "from_id long, to_id long")
    pairs = spark.createDataFrame([(0, 20), (0, 32), (5, 5), (1, 3), (20, 0), (32, 1)], "from_id long, to_id long")
    return graph.shortest_paths(link, pairs).select(F.col("from_id").cast("int").alias("from_id"), F.col("to_id").cast("int").alias("to_id"), _joined("path").alias("path"))


def _star(spark, callers: int):
    s = table_of(spark, [{"id": 1, "fqn": "lib.py::target", "file_path": "lib.py", "start_line": 3}] + [{"id": 10 + i, "fqn": f"lib.py::caller_{i:02d}", "file_path": "lib.py", "start_line": 10 + i} for i in range(callers)])
    link = spark.createDataFrame([(10 + i, 1) for i in range(callers)], "from_id long, to_id long")
    cent = graph.centrality(graph.degrees(link, s))
    return s, link, cent, spark.createDataFrame([(1,)], "id long")


@CORE.add("g07_cases", values("relation, shown, total_affected, truncated", "('direct', 10, 120, 50)", "('transitive', 10, 120, 50)"))
def g07_cases(spark, sf_dir):
    """A target with sixty callers and a cap of ten: what is shown, counted and cut off."""
    s, link, cent, seed = _star(spark, 60)
    rows = graph.impact(link, s, cent, seed, max_results=10)
    return rows.groupBy("relation").agg(F.count(F.lit(1)).cast("int").alias("shown"), F.max("total_affected").cast("int").alias("total_affected"), F.max("truncated").cast("int").alias("truncated"))


@CORE.add(
    "c06_cases",
    values(
        "markdown",
        "('## Impact graph: lib.py::target\n\nTotal affected: 6\n\n### Direct dependents (2 shown, 1 more truncated)\n- `lib.py::caller_00` (lib.py:10)\n- `lib.py::caller_01` (lib.py:11)\n- … + 1 more\n\n### Transitive dependents (2 shown, 1 more truncated)\n- `lib.py::caller_00` (lib.py:10)\n- `lib.py::caller_01` (lib.py:11)\n- … + 1 more')",
    ),
)
def c06_cases(spark, sf_dir):
    """An impact query as text."""
    s, link, cent, seed = _star(spark, 3)
    return capsule.render_impact(graph.impact(link, s, cent, seed, max_results=2), s).select("markdown")


# ---- anchors ----------------------------------------------------------------------------------------------------------

_TEXTS = [
    "The `needs_extensions` check runs late",
    "```python\nxr.where(True, x)\n```",
    "```\nfrom sympy.parsing.latex import parse_latex\n```",
    "plain words only, nothing else",
    "",
    "calls urllib.request.urlopen internally",
    'Traceback:\n  File "a/run.py", line 3, in <module>\n  File "a/run.py", line 9, in my_func\n  File "a/frame.py", line 1, in apply\n',
    '  File "m.py", line 1, in Mod.eval\n  File "m.py", line 2, in go\n  File "m.py", line 3, in call\n',
    'see File "a.py", line 3, in middle_name of a line',
]


@CORE.add(
    "x07_cases",
    values(
        "id, names, modules, frames",
        "(1, 'needs_extensions', '', '')", "(2, 'xr.where where', '', '')", "(3, 'parse_latex sympy.parsing.latex latex', 'sympy.parsing.latex', '')", "(4, '', '', '')", "(5, '', '', '')", "(6, 'urllib.request.urlopen urlopen', '', '')",
        "(7, 'my_func apply Traceback run.py frame.py', '', 'a/run.py:my_func a/frame.py:apply')", "(8, 'Mod.eval eval m.py', '', 'm.py:Mod.eval')", "(9, 'middle_name a.py', '', '')",
    ),
)
def x07_cases(spark, sf_dir):
    """Names, modules and frames of small texts, in order."""
    t = F.col("text")
    d = spark.createDataFrame([(i + 1, x) for i, x in enumerate(_TEXTS)], "id int, text string")
    return d.select("id", _joined(A.anchors(t)).alias("names"), _joined(A.module_paths(t)).alias("modules"), _joined(F.transform(A.frames(t), lambda x: F.concat_ws(":", x["path"], x["function"]))).alias("frames"))


@CORE.add("x03_cases", values("id, names, modules", "(1, 'a b', 'm.n')", "(2, 'n', 'm.n')", "(3, 'x y z', 'p q.z')", "(4, '', '')"))
def x03_cases(spark, sf_dir):
    t = F.col("text")
    d = spark.createDataFrame([(1, "from m.n import a, b"), (2, "import m.n"), (3, "use `from p import x, y`;\nimport q.z"), (4, "important imports")], "id int, text string")
    return d.select("id", _joined(A.imported(t)).alias("names"), _joined(A.module_paths(t)).alias("modules"))


# ---- search and ranking -----------------------------------------------------------------------------------------------


@CORE.add("r03_cases", values("query_id, id, rank", "(1, 4, 1)", "(1, 1, 2)", "(2, 2, 1)", "(2, 3, 2)"))
def r03_cases(spark, sf_dir):
    """All words of the query side by side in the name, the shortest name first; bodies are not searched."""
    s = table_of(spark, [{"id": 1, "fqn": "verify_needs_extensions"}, {"id": 2, "fqn": "bump_version"}, {"id": 3, "fqn": "parse_version", "body": "needs_extensions"}, {"id": 4, "fqn": "needs_extensions"}])
    got = bm25.search_name(s, _one(spark, "needs_extensions", "version"))
    return got.select(*[F.col(c).cast("int").alias(c) for c in ("query_id", "id", "rank")])


def _ranked(df, *cols: str):
    return df.select(*[F.col(c).cast("int").alias(c) for c in cols])


@CORE.add("r05_cases", values("query_id, id, rank", "(1, 1, 1)", "(1, 2, 2)", "(1, 3, 3)", "(2, 5, 1)", "(3, 6, 1)"))
def r05_cases(spark, sf_dir):
    """A name that three files define, a method by its dotted name, and a name that only occurs inside another one."""
    s = table_of(spark, [{"id": i, "fqn": f"f{i}.py::parse_latex_xyz"} for i in (1, 2, 3)] + [{"id": 5, "fqn": "g.py::Buffer::flush_all"}, {"id": 6, "fqn": "h.py::verify_needs_extensions"}, {"id": 7, "fqn": "h.py::other"}])
    return _ranked(ranking.anchor_candidates(s, _one(spark, "why does parse_latex_xyz fail", "crash in Buffer.flush_all()", "The `needs_extensions` check")), "query_id", "id", "rank")


@CORE.add("r06_cases", values("query_id, id, rank", "(1, 1, 1)", "(1, 3, 2)"))
def r06_cases(spark, sf_dir):
    """Frames name a function and the end of its file's path, so the same name elsewhere is no candidate."""
    s = table_of(spark, [{"id": 1, "fqn": "src/io/buffer.py::Buffer::flush", "file_path": "src/io/buffer.py"}, {"id": 2, "fqn": "src/io/sink.py::flush", "file_path": "src/io/sink.py"}, {"id": 3, "fqn": "src/run.py::main_loop", "file_path": "src/run.py"}])
    text = 'Traceback\n  File "io/buffer.py", line 3, in flush\n  File "run.py", line 7, in main_loop\n'
    return _ranked(ranking.traceback_candidates(s, _one(spark, text)), "query_id", "id", "rank")


_ERROR = [
    {"id": 1, "fqn": "myerror.py::MyError", "kind": "class", "file_path": "myerror.py", "signature": "class MyError(Exception)", "body": "class MyError(Exception):\n    def __str__(self):\n        a = 1\n        return 'x'"},
    {"id": 2, "fqn": "raiser.py::raise_my_error", "file_path": "raiser.py", "signature": "def raise_my_error()", "body": "def raise_my_error():\n    raise MyError()"},
    {"id": 3, "fqn": "caller.py::caller_of_raise_my_error", "file_path": "caller.py", "signature": "def caller_of_raise_my_error()", "body": "def caller_of_raise_my_error():\n    raise_my_error()"},
    *[{"id": 10 + i, "fqn": f"noise{i}.py::noise_{i}", "file_path": f"noise{i}.py", "signature": f"def noise_{i}()", "body": f"def noise_{i}():\n    return {i}"} for i in range(10)],
]


def _error_graph(spark):
    s = table_of(spark, _ERROR)
    return s, spark.createDataFrame([(2, 1, "calls"), (3, 2, "calls")], "from_id long, to_id long, kind string")


@CORE.add("r07_cases", values("id, rank, score", "(2, 1, 0.5::DOUBLE)", "(3, 2, 0.333333::DOUBLE)"))
def r07_cases(spark, sf_dir):
    """Above an exception type: who raises it, and who calls that."""
    s, link = _error_graph(spark)
    cent = graph.centrality(graph.degrees(link, s))
    q = pipeline.prepared(_one(spark, "fix MyError crash"))
    named = ranking.anchor_candidates(s, q)
    out = ranking.reverse_expand(link, s, cent, named, q)
    return out.select(F.col("id").cast("int").alias("id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@CORE.add("r14_cases", values("id, score", "(1, 0.7::DOUBLE)", "(2, 0.5::DOUBLE)", "(3, 0.25::DOUBLE)"))
def r14_cases(spark, sf_dir):
    """Half the score and half the similarity; none and a negative one change nothing."""
    scored = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.5), (1, 3, 0.25)], "query_id int, id int, score double")
    sem = spark.createDataFrame([(1, 1, 0.6), (1, 3, -0.4)], "query_id int, id int, similarity double")
    return ranking.semantic_blend(scored, sem).select("id", F.round("score", 6).alias("score"))


@CORE.add("r16_cases", values("id, score, rank", "(1, 0.9::DOUBLE, 1)", "(3, 0.5::DOUBLE, 2)", "(4, 0.3::DOUBLE, 3)"))
def r16_cases(spark, sf_dir):
    """One row per name, the better one; a stub counts three tenths, so it falls behind."""
    s = table_of(spark, [{"id": 1, "fqn": "a"}, {"id": 2, "fqn": "a"}, {"id": 3, "fqn": "b"}, {"id": 4, "fqn": "c", "is_stub": True}])
    scored = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 0), (1, 3, 0.5, 0), (1, 4, 1.0, 0)], "query_id int, id long, score double, hub int")
    out = ranking.dedup_and_penalise(scored, s)
    return out.select(F.col("id").cast("int").alias("id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@CORE.add("f01_cases", values("query_id, id", "(1, 1)", "(2, 2)", "(3, 1)", "(4, 1)", "(4, 2)"))
def f01_cases(spark, sf_dir):
    """Filters by language in any case, by a part of the path, by score, and none."""
    s = table_of(spark, [{"id": 1, "fqn": "a", "file_path": "src/a.py"}, {"id": 2, "fqn": "b", "language": "rust", "file_path": "lib/b.rs"}])
    q = spark.createDataFrame([(1, "t", "Python", None, None), (2, "t", None, "lib/", None), (3, "t", None, None, 0.5), (4, "t", None, None, None)], "query_id int, task string, language string, file_hint string, min_score double")
    ranked = q.select("query_id").crossJoin(spark.createDataFrame([(1, 0.9, 1), (2, 0.2, 2)], "id long, score double, rank int"))
    return _ranked(ranking.post_filter(ranked, s, q), "query_id", "id")


@CORE.add("r18_cases", values("place, id", "(1, 3)", "(2, 5)", "(3, 1)"))
def r18_cases(spark, sf_dir):
    """Pins come first, the deepest name of a file for it; then the ranking goes on; imports, stubs and trivial exceptions are none."""
    s = table_of(
        spark,
        [{"id": 1, "fqn": "a.py::top", "file_path": "a.py"}, {"id": 2, "fqn": "b.py::FooXyz", "kind": "class", "file_path": "b.py"}, {"id": 3, "fqn": "b.py::FooXyz::bar_xyz", "kind": "method", "file_path": "b.py"}, {"id": 4, "fqn": "c.py::import x", "kind": "import", "file_path": "c.py"}, {"id": 5, "fqn": "d.py::named_one", "file_path": "d.py"}, {"id": 6, "fqn": "e.py::BadError", "kind": "class", "file_path": "e.py", "body": "class BadError(Exception):\n    pass"}, {"id": 7, "fqn": "f.pyi::stub", "file_path": "f.pyi", "is_stub": True}],
    )
    ranked = spark.createDataFrame([(1, 7, 1), (1, 4, 2), (1, 6, 3), (1, 1, 4), (1, 3, 5)], "query_id int, id long, rank int")
    named = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 5, 3), (1, 4, 4)], "query_id int, id long, rank int")
    return _ranked(ranking.pivots(ranked, s, named, named.where("false"), 3), "place", "id")


@CORE.add("r19_cases", values("query_id, place, id", "(1, 1, 2)", "(1, 2, 3)", "(2, 1, 4)", "(3, 1, 2)", "(3, 2, 3)", "(3, 3, 4)"))
def r19_cases(spark, sf_dir):
    """A debugging task sees what its pivot calls, a refactoring one who calls it, another both; two of a file at most."""
    s = table_of(spark, [{"id": i, "fqn": f"s{i}", "file_path": "x.py" if i in (2, 3, 5) else f"{i}.py"} for i in range(1, 6)])
    link = spark.createDataFrame([(1, 2), (1, 3), (1, 5), (4, 1)], "from_id long, to_id long")
    chosen = spark.createDataFrame([(q, 1, 1) for q in (1, 2, 3)], "query_id long, place int, id long")
    q = pipeline.prepared(_one(spark, "fix the crash", "refactor the loader", "wonder"))
    return _ranked(ranking.adjacents(chosen, link, s, q), "query_id", "place", "id")


@CORE.add("r21_cases", values("how, query_id, place, id", "('similar', 1, 1, 'b')", "('similar', 1, 2, 'a')", "('latest', 1, 1, 'd')", "('latest', 1, 2, 'b')", "('latest', 2, 1, 'd')", "('latest', 2, 2, 'b')"))
def r21_cases(spark, sf_dir):
    """Observations of a task by similarity, at least 0.3, else the latest; expired ones never."""
    at = lambda d: NOW - dt.timedelta(days=d)
    o = spark.createDataFrame([("a", "x", at(5), None), ("b", "x", at(2), None), ("c", "x", at(1), at(0.5)), ("d", "x", at(1), None)], "id string, content string, created_at timestamp_ntz, expires_at timestamp_ntz").withColumns({"symbol_fqn": F.lit(None).cast("string"), "is_stale": F.lit(False)})
    sim = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.9), (1, "c", 0.8), (1, "d", 0.29)], "query_id long, id string, similarity double")
    q = _one(spark, "t", "u")
    near = memory.for_tasks(o, q, NOW, 2, sim.where("id <> 'c'")).withColumn("how", F.lit("similar"))
    return near.unionByName(memory.for_tasks(o, q, NOW, 2).withColumn("how", F.lit("latest"))).select("how", F.col("query_id").cast("int").alias("query_id"), "place", "id")


@CORE.add("r22_cases", values("fqn, chosen", "('caller.py::caller_of_raise_my_error', true)", "('raiser.py::raise_my_error', true)", "('myerror.py::MyError', true)"))
def r22_cases(spark, sf_dir):
    """The whole way for one task: the exception it names, who raises it, and who calls that, are its pivots; noise is not."""
    s, link = _error_graph(spark)
    ix = pipeline.Index.build(s, s, link)
    chosen = pipeline.select(ix, _one(spark, "fix MyError crash"), max_pivots=3).pivots
    return chosen.join(s.select("id", "fqn"), "id").select("fqn", F.lit(True).alias("chosen"))


# ---- packing ----------------------------------------------------------------------------------------------------------


def _pack(spark):
    s = table_of(
        spark,
        [{"id": 1, "fqn": "a.py::small", "file_path": "a.py", "signature": "def small()", "body": "def small():\n    return 1"}, {"id": 2, "fqn": "a.py::large", "file_path": "a.py", "signature": "def large()", "docstring": "Large.", "body": "def large():\n" + "    x = 1\n" * 400}, {"id": 3, "fqn": "b.py::near", "file_path": "b.py", "signature": "def near()"}, {"id": 4, "fqn": "b.py::far", "file_path": "b.py", "signature": "def far()" + "y" * 2000}],
    )
    q = pipeline.prepared(spark.createDataFrame([(1, "small", 100)], "query_id long, task string, budget int"))
    chosen = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, place int, id long")
    near = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 3, 1)], "query_id long, place int, id long")
    full = capsule.pack_pivots(chosen, s, q)
    return s, q, full, capsule.pack_adjacents(full, near, s, q)


@CORE.add("c01_cases", values("place, id, form, tokens", "(1, 1, 'whole', 6)", "(1, 3, 'adjacent', 2)"))
def c01_cases(spark, sf_dir):
    """Whole what fits, a window or an outline of what does not; outlines stop at the first that is too long."""
    _, _, full, brief = _pack(spark)
    small = full.where("id = 1").select("place", "id", "form", "tokens")
    return small.unionByName(brief.select("place", "id", F.lit("adjacent").alias("form"), "tokens")).select("place", F.col("id").cast("int").alias("id"), "form", F.col("tokens").cast("int").alias("tokens"))


@CORE.add("c01_budget_cases", values("n_pivots, n_skeletons, fits, reserve_counted", "(2, 1, true, true)"))
def c01_budget_cases(spark, sf_dir):
    """The sums of the same capsule: within the budget, the reserve for memories included."""
    _, q, full, brief = _pack(spark)
    total = F.col("total_tokens")
    return capsule.summary(full, brief, q).select(F.col("n_pivots").cast("int").alias("n_pivots"), F.col("n_skeletons").cast("int").alias("n_skeletons"), (total <= 100).alias("fits"), (total >= 15).alias("reserve_counted"))


@CORE.add("c02_cases", values("markdown", "('# small\n\n### a.py::small\n```python\ndef small():\n    return 1\n```\n\n## Related\n- b.py::near: def near()\n\n## Memory\n- 2024-09-01 00:00:00 (re: `a.py::small`) [stale]: kept')"))
def c02_cases(spark, sf_dir):
    """A capsule with a pivot, an outline and an observation as text."""
    s, q, full, brief = _pack(spark)
    notes = spark.createDataFrame([(1, 1, "o", "kept", NOW, "a.py::small", True)], "query_id long, place int, id string, content string, created_at timestamp_ntz, symbol_fqn string, is_stale boolean")
    return capsule.render(full.where("id = 1"), brief, s, q, capsule.pack_memories(notes, q)).select("markdown")


@CORE.add("x08_cases", values("id, has_topic, first_line, fits", "(1, true, true, true)", "(2, false, true, true)"))
def x08_cases(spark, sf_dir):
    """A long body is cut to the window with the words of the task; a short one is left as it is."""
    long = "\n".join(["def handle(request):"] + [f"    step_{i} = compute_value_{i}(request)" for i in range(20)] + ["    jwt = read_jwt(request)", "    validate_signature(jwt)"] + [f"    tail_{i} = compute_value_{i}(request)" for i in range(20)])
    rows = [(i, capsule.chunk_for_query(b, "jwt signature", 150)) for i, b in ((1, long), (2, "def f():\n    return 1"))]
    d = spark.createDataFrame(rows, "id int, text string")
    return d.select("id", (F.col("text").contains("read_jwt") & F.col("text").contains("validate_signature")).alias("has_topic"), F.col("text").startswith("def ").alias("first_line"), (F.octet_length("text") <= 700).alias("fits"))


@CORE.add("c04_cases", values("id, text", "(1, 'Says hello.\ndef greet(name)\n    ...')", "(2, 'fn add(a: u8) { ... }')", "(3, 'const X = 1')", "(4, 'enum E { A }')", "(5, 'class C:\n    def a(self): ...\n    def b(self): ...')"))
def c04_cases(spark, sf_dir):
    """Outlines by kind: functions lose their code, short types and constants stay, classes keep their members."""
    body = "class C:\n    def a(self):\n        return 1\n\n    def b(self):\n        return 2\n"
    s = table_of(
        spark,
        [{"id": 1, "fqn": "greet", "signature": "def greet(name)", "docstring": "Says hello.", "body": "def greet(name):\n    return 1"}, {"id": 2, "fqn": "add", "language": "rust", "signature": "fn add(a: u8)", "body": "fn add(a: u8) {}"}, {"id": 3, "fqn": "X", "kind": "constant", "signature": "const X = 1", "body": "const X = 1;"}, {"id": 4, "fqn": "E", "kind": "enum", "language": "rust", "signature": "enum E", "body": "enum E { A }"}, {"id": 5, "fqn": "C", "kind": "class", "signature": "class C:", "body": body}],
    )
    return capsule.file_skeleton(s).select(F.col("id").cast("int").alias("id"), "text")


@CORE.add("f10_cases", values("id", "(1)", "(2)"))
def f10_cases(spark, sf_dir):
    """Outlines down to a depth of one: no nested names."""
    s = table_of(spark, [{"id": 1, "fqn": "lib.rs::Foo"}, {"id": 2, "fqn": "lib.rs::top_fn"}, {"id": 3, "fqn": "lib.rs::Foo::method"}])
    return capsule.file_skeleton(s, 1).select(F.col("id").cast("int").alias("id"))


@CORE.add("c03_cases", values("id, role", "(1, 'pivot')", "(2, 'dependent')", "(3, 'test')"))
def c03_cases(spark, sf_dir):
    """What a diff touches, who calls it, and a test that names it."""
    s = table_of(
        spark,
        [{"id": 1, "fqn": "a.py::load_rows", "file_path": "a.py", "start_line": 5, "end_line": 9}, {"id": 2, "fqn": "b.py::use", "file_path": "b.py"}, {"id": 3, "fqn": "tests/test_a.py::test_load", "file_path": "tests/test_a.py", "body": "def test_load():\n    assert load_rows(1)"}, {"id": 4, "fqn": "a.py::other", "file_path": "a.py", "start_line": 20, "end_line": 30}],
    )
    link = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    d = spark.createDataFrame([(1, "--- a/a.py\n+++ b/a.py\n@@ -7,1 +8,2 @@\n+x\n")], "diff_id int, diff string")
    return diff.impact(diff.touched(diff.hunks(d), s), link, s).select(F.col("id").cast("int").alias("id"), "role")


# ---- memory and enrichment --------------------------------------------------------------------------------------------


@CORE.add("m10_cases", values("leader, n, members, content", "('a', 2, 'a b', 'Agent queried: \"one\"; \"two\" — pivots: p, q, r')"))
def m10_cases(spark, sf_dir):
    """Two observations point the same way and become one, with each query and pivot once; the third stays alone."""
    at = lambda d: NOW - dt.timedelta(days=d)
    text = lambda q, p: f'Agent queried: "{q}" — pivots: {p}'
    rows = [("a", text("one", "p, q"), at(3), [1.0, 0.0]), ("b", text("two", "q, r"), at(2), [1.0, 0.05]), ("c", text("three", "z"), at(1), [0.0, 1.0]), ("d", text("four", "z"), at(1), None)]
    o = spark.createDataFrame(rows, "id string, content string, created_at timestamp_ntz, embedding array<float>").withColumns({"kind": F.lit("auto"), "expires_at": F.lit(None).cast("timestamp_ntz"), "session_id": F.lit("s")})
    return memory.consolidate(o, NOW).select("leader", "n", _joined("members").alias("members"), "content")


@CORE.add("c05_cases", values("id, line", "('1', '[manual] note @ a.py::f\ndef f(x):\nline 1\nline 2')", "('2', '[auto] other [stale] @ gone')", "('3', '[manual] free')"))
def c05_cases(spark, sf_dir):
    """Observations at the third level of detail: with signature and body of the symbol that they are about."""
    s = table_of(spark, [{"id": 1, "fqn": "a.py::f", "signature": " def f(x): ", "body": "line 1\nline 2"}])
    o = spark.createDataFrame([("1", "note", None, "a.py::f", False), ("2", "other", "auto", "gone", True), ("3", "free", None, None, None)], "id string, content string, kind string, symbol_fqn string, is_stale boolean")
    return memory.session_lines(o, "L3", s)


@CORE.add("x15_cases", values("file_path, line, type", "('a.py', 4, 'int')", "('b.py', 1, 'list[str]')"))
def x15_cases(spark, sf_dir):
    """Revealed types in a checker's report; errors and other messages are none."""
    import json

    item = lambda f, s, m, n: {"file": f"/root/{f}", "severity": s, "message": m, "range": {"start": {"line": n}}}
    report = {"generalDiagnostics": [item("a.py", "information", 'Type of "x" is "int"', 3), item("b.py", "information", 'Type of "y" is "list[str]"', 0), item("a.py", "error", 'Type of "z" is "str"', 9), item("a.py", "information", "unused", 2)]}
    return enrich.parse_diagnostics(spark.createDataFrame([(json.dumps(report),), ("no json",)], "json string"), "/root")


@CORE.add("x16_cases", values("key, type", "('m::load', 'Result<Vec<u8>, Error>')", "('m::run', '()')", "('Token', 'Clone, Debug')"))
def x16_cases(spark, sf_dir):
    """Return types and traits in a document of the Rust documentation's form."""
    import json

    arg = lambda t: {"type": t}
    path = lambda n, *a: {"resolved_path": {"name": n, "args": {"angle_bracketed": {"args": [arg(x) for x in a]}}}}
    made = {"index": {"1": {"name": "load", "inner": {"function": {"sig": {"output": path("Result", path("Vec", {"primitive": "u8"}), path("Error"))}}}}, "2": {"name": "run", "inner": {"function": {"sig": {"output": None}}}}, "3": {"inner": {"impl": {"trait": {"name": "Debug"}, "for": path("Token")}}}, "4": {"inner": {"impl": {"trait": {"path": "std::clone::Clone"}, "for": path("Token")}}}}, "paths": {"1": {"path": ["c", "m", "load"]}, "2": {"path": ["c", "m", "run"]}}}
    return enrich.parse_rustdoc(spark.createDataFrame([(json.dumps(made),), ("{",)], "json string"))


@CORE.add("x17_cases", values("fqn, resolved_type, line", "('a.ts::f', 'Promise<void>', 3)", "('a.ts::g', 'number', NULL)"))
def x17_cases(spark, sf_dir):
    lines = ['{"fqn": "a.ts::f", "resolved_type": "Promise<void>", "line": 3}', '{"fqn": "a.ts::g", "resolved_type": "number"}', '{"fqn": "", "resolved_type": "x"}', '{"fqn": "a.ts::h", "resolved_type": ""}', "broken", ""]
    return enrich.parse_script_facts(spark.createDataFrame([(x,) for x in lines], "value string"))


@CORE.add("x19_cases", values("id, uses", "(1, true)", "(2, false)", "(3, true)", "(4, false)", "(5, true)"))
def x19_cases(spark, sf_dir):
    """Macros of one's own and derived code call for expansion; the usual ones do not."""
    bodies = ["fn f() { my_macro!(1); }", 'fn f() { println!("x"); vec![1]; }', "#[derive(Debug)]\nstruct A;", "fn f() -> bool { a != b }", "lazy_static! { static ref X: u8 = 1; }"]
    return spark.createDataFrame([(i + 1, b) for i, b in enumerate(bodies)], "id int, body string").select("id", enrich.uses_macros(F.col("body")).alias("uses"))


@CORE.add("n01_cases", values("fqn, source", "('a::f', NULL)", "('a::new', 'macro_expanded')"))
def n01_cases(spark, sf_dir):
    """Only names that are new come from expanded source."""
    s, x = table_of(spark, [{"id": 1, "fqn": "a::f"}]), table_of(spark, [{"id": 7, "fqn": "a::f"}, {"id": 8, "fqn": "a::new"}])
    return enrich.add_expanded(s, x).select("fqn", "source")


@CORE.add("n02_cases", values("id, resolved_type, source", "(1, 'Vec<u8>', 'rustdoc')", "(2, 'bool', 'rustdoc')", "(3, NULL, NULL)", "(4, NULL, NULL)"))
def n02_cases(spark, sf_dir):
    """Rust types by the longest end of the name; other languages are left alone."""
    s = table_of(spark, [{"id": 1, "fqn": "x.rs::m::load", "language": "rust"}, {"id": 2, "fqn": "x.rs::check", "language": "rust"}, {"id": 3, "fqn": "x.rs::free", "language": "rust"}, {"id": 4, "fqn": "x.py::check"}])
    facts = spark.createDataFrame([("m::load", "Vec<u8>"), ("load", "String"), ("check", "bool")], "key string, type string")
    return enrich.rust_types(s, facts).select(F.col("id").cast("int").alias("id"), "resolved_type", "source")


@CORE.add("n04_cases", values("id, resolved_type", "(1, 'exact')", "(2, 'tail')", "(3, NULL)"))
def n04_cases(spark, sf_dir):
    """Script types: the exact name before its end."""
    s = table_of(spark, [{"id": 1, "fqn": "x.ts::A::run", "language": "typescript"}, {"id": 2, "fqn": "y.ts::B::stop", "language": "typescript"}, {"id": 3, "fqn": "z.py::B::stop"}])
    facts = spark.createDataFrame([("x.ts::A::run", "exact"), ("A::run", "near"), ("B::stop", "tail")], "fqn string, resolved_type string")
    return enrich.script_types(s, facts).select(F.col("id").cast("int").alias("id"), "resolved_type")


@CORE.add("n07_cases", values("key, dim, norm, same", "(1, 64, 1.0::DOUBLE, true)", "(2, 64, 1.0::DOUBLE, true)", "(3, 64, 0.0::DOUBLE, true)"))
def n07_cases(spark, sf_dir):
    """Vectors have one length and norm one (an empty text none); word order does not matter to the stand-in."""
    d = spark.createDataFrame([(1, "load the rows", "rows the load"), (2, "x", "X"), (3, "", "")], "key int, a string, b string")
    a = enrich.embed(d, "key", "a", enrich.HashEmbedder())
    b = enrich.embed(d, "key", "b", enrich.HashEmbedder()).withColumnRenamed("embedding", "other")
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return a.join(b, "key").select("key", F.size("embedding").alias("dim"), norm.alias("norm"), (F.col("embedding") == F.col("other")).alias("same"))
