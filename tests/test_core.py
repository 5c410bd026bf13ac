import datetime as dt

import pytest
from conftest import SF

from codeweft import config
from codeweft.functions import anchors as A
from codeweft.functions import text as X
from codeweft.operators import capsule, diff, edges, enrich, graph, memory, skew, stats, store
from codeweft.streaming import changes as C
from pyspark.sql import functions as F


def col(spark, f, value, *more):
    return spark.createDataFrame([(value, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more)))).select(f(*[F.col(f"c{i}") for i in range(1 + len(more))])).first()[0]


# ---- skew

def test_salted_counts_equal_plain(spark):
    rows = [(7, "a", i % 900) for i in range(3000)] + [(i, "b", i % 5) for i in range(200)] + [(7, None, 1), (None, "a", 2), (7, "a", None)] * 2
    df = spark.createDataFrame(rows, "to_id long, kind string, from_id long").withColumn("n_rows", F.lit("clash"))
    got = {(r.to_id, r.kind): (r.n_rows, r.n_distinct) for r in skew.salted_distinct_count(df, ["to_id", "kind"], "from_id").collect()}
    want = {(r.to_id, r.kind): (r.a, r.b) for r in df.groupBy("to_id", "kind").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("from_id").alias("b")).collect()}
    assert got == want
    assert skew.salted_distinct_count(df.where("false"), ["to_id"], "from_id").count() == 0
    salts = skew.salted(df, ["to_id", "kind"], "from_id").where("to_id = 7 AND kind = 'a'").select("__salt").distinct().count()
    assert salts > 30
    top = skew.dominant_keys(df.where("to_id IS NOT NULL AND kind IS NOT NULL AND from_id IS NOT NULL"), ["to_id", "kind"], "from_id", 0.5).collect()
    assert [(r.to_id, r.kind, r.n_distinct) for r in top] == [(7, "a", 900)]
    s = {r.to_id: (r.n_rows, r.total) for r in skew.salted_sum(df, ["to_id"], "from_id", "from_id").collect()}
    assert s[7][0] == 3000 + 1 + 2 + 2


# ---- graph

def tiny(spark, pairs, n=None):
    ids = sorted({x for p in pairs for x in p} | set(range(n or 0)))
    nodes = spark.createDataFrame([(i, f"f.py::s{i}", f"s{i}", "function", "f.py", False) for i in ids], "id long, fqn string, name string, kind string, file_path string, is_stub boolean")
    e = spark.createDataFrame([(a, b, " Calls ", None) for a, b in pairs], "from_id long, to_id long, kind string, label string")
    return graph.links(e, nodes), nodes


def test_half_point_and_scores(spark):
    link, nodes = tiny(spark, [(0, 4), (1, 4), (2, 4), (3, 4), (0, 3), (1, 3), (0, 2)])
    deg = graph.degrees(link, nodes)
    assert sorted(r.raw for r in deg.collect()) == [2, 3, 3, 5, 8]
    assert graph.half_point(deg).first().k == 3 and graph.half_point(deg, override=42).first().k == 42
    c = {r.id: r.centrality for r in graph.centrality(deg).collect()}
    assert c[0] == 0.5
    lone, nodes = tiny(spark, [], 3)
    assert graph.half_point(graph.degrees(lone, nodes)).first().k == 1
    assert graph.half_point(deg.where("false")).first().k == 15


def test_links_first_kind_and_unknown_ends(spark):
    nodes = tiny(spark, [(1, 2)])[1]
    e = spark.createDataFrame([(1, 2, "references", "x"), (1, 2, "CALLS ", "y"), (1, 1, "calls", ""), (1, 9, "calls", ""), (2, 1, None, ""), (2, 1, "odd", ""), (None, 1, "calls", "")], "from_id long, to_id long, kind string, label string")
    assert sorted(tuple(r) for r in graph.links(e, nodes).collect()) == [(1, 2, "calls"), (2, 1, "references")]


def test_walks(spark):
    link, nodes = tiny(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (5, 3), (1, 6), (6, 3)])
    seeds = nodes.where("id = 3").select("id")
    assert {(r.id, r.depth) for r in graph.blast_radius(link, seeds, 3).collect()} == {(2, 1), (5, 1), (6, 1), (1, 2)}
    assert graph.blast_radius(link, seeds, 1).count() == 0
    pairs = spark.createDataFrame([(1, 4), (1, 1), (3, 5), (2, 1)], "from_id long, to_id long")
    got = {(r.from_id, r.to_id): r.path for r in graph.shortest_paths(link, pairs).collect()}
    assert got == {(1, 4): [1, 2, 3, 4], (1, 1): [1], (2, 1): [2, 3, 4, 1]}


def test_impact_caps(spark):
    link, nodes = tiny(spark, [(i, 0) for i in range(1, 61)])
    cent = graph.centrality(graph.degrees(link, nodes))
    rows = graph.impact(link, nodes, cent, nodes.where("id = 0").select("id"), max_results=10).collect()
    assert sum(r.relation == "direct" for r in rows) == 10 and rows[0].total_affected == 120 and rows[0].truncated == 50


def test_family(spark):
    nodes = spark.createDataFrame([(1, "a::Foo", "Foo", "class", "a", False), (2, "a::Foo::m", "Foo::m", "method", "a", False), (3, "a::g", "g", "function", "a", False)], "id long, fqn string, name string, kind string, file_path string, is_stub boolean")
    e = spark.createDataFrame([(3, 2, "calls", None), (3, 1, "calls", None)], "from_id long, to_id long, kind string, label string")
    got = graph.family(graph.degrees(graph.links(e, nodes), nodes), nodes).collect()
    assert [(r.id, r.total) for r in got] == [(1, 2)]


# ---- text and anchors

@pytest.mark.parametrize("task,want", [("Fix the crash", "debug"), ("prefix lookups", "debug"), ("rename it", "refactor"), ("the hub class", "structural"), ("how does it work", "explore"), ("the address", "add"), ("", "general")])
def test_intent(spark, task, want):
    assert col(spark, X.intent, task) == want


def test_secrets(spark):
    assert col(spark, X.sensitive_name, "a/.env.local") and col(spark, X.sensitive_name, "x/server.PEM") and not col(spark, X.sensitive_name, "a/b.py")
    assert col(spark, X.holds_key, "k = AKIAABCDEFGHIJKL") and not col(spark, X.holds_key, "sk-abc")


def test_anchors(spark):
    names = lambda t: col(spark, A.anchors, t)
    assert "needs_extensions" in names("The `needs_extensions` check")
    assert names("```python\nxr.where(True, 1)\n```")[:2] == ["xr.where", "where"]
    assert "parse_latex" in names("from sympy.parsing.latex import parse_latex") and col(spark, A.module_paths, "from sympy.parsing.latex import parse_latex") == ["sympy.parsing.latex"]
    assert names("calls urllib.request.urlopen internally") == ["urllib.request.urlopen", "urlopen"]
    assert names("plain english words only") == [] and names("") == []
    tb = 'Traceback:\n  File "a/b.py", line 3, in <module>\n  File "a/c.py", line 9, in my_func\n'
    assert [(f.path, f.function) for f in col(spark, A.frames, tb)] == [("a/c.py", "my_func")]
    n = names("Use MyClass\n```py\nmy_func(1)\n```")
    assert n.index("my_func") < n.index("MyClass")


# ---- edges

def syms(spark, rows):
    full = [(i, f"{p}::{n}", n, n.split("::")[-1], k, p, b.split("\n")[0], b, lang, False) for i, n, k, p, b, lang in rows]
    return spark.createDataFrame(full, "id long, fqn string, name string, leaf_name string, kind string, file_path string, signature string, body string, language string, is_stub boolean")


def test_edges(spark):
    s = syms(spark, [
        (1, "compute", "function", "a.py", "def compute(a, b):\n    return a + b", "python"),
        (2, "caller", "function", "b.py", 'def caller():\n    """evalf(1)"""\n    return compute(1, 2, "hello")', "python"),
        (3, "evalf", "function", "c.py", "def evalf(x):\n    return x * 2  # padding", "python"),
        (4, "from a import compute as c, x", "import", "b.py", "from a import compute as c, x", "python"),
        (5, "UserToken", "struct", "d.rs", "struct UserToken { id: u64 }", "rust"),
        (6, "validate", "function", "d.rs", "fn validate(token: UserToken) -> bool { true }", "rust"),
        (7, "foo", "function", "e.sh", "foo() {\n  bar | baz\n  foo\n}", "shell"),
        (8, "bar", "function", "e.sh", "bar() { :; }", "shell"),
        (9, "baz", "function", "e.sh", "baz() { :; }", "shell"),
        (10, "users", "struct", "f.sql", "CREATE TABLE users (id INT)", "sql"),
        (11, "v", "type_alias", "f.sql", "CREATE VIEW v AS SELECT * FROM app.Users WHERE 1", "sql"),
        (12, "Show", "trait", "g.rs", "trait Show {}", "rust"),
        (13, "impl::Show for UserToken", "impl", "g.rs", "impl Show for UserToken {}", "rust"),
    ])
    got = {(r.from_id, r.to_id, r.kind): r.label for r in edges.extract(s).collect()}
    assert got[2, 1, "calls"].startswith("compute(1, 2") and (2, 3, "calls") not in got
    assert (4, 1, "imports") in got and (6, 5, "references") in got and (5, 12, "implements") in got
    assert (7, 8, "calls") in got and (7, 9, "calls") in got and (7, 7, "calls") not in got and (11, 10, "references") in got


# ---- capsule and diff

def test_chunks_and_skeletons():
    body = "\n".join(["def f():"] + [f"    line_{i} = {i}" for i in range(20)] + ["    jwt = validate_signature(token)  # jwt"] + [f"    more_{i} = {i}" for i in range(24)])
    out = capsule.chunk_for_query(body, "jwt validate", 60)
    assert "validate_signature" in out and len(out) < len(body) and capsule.chunk_for_query("a\nb\nc", "x", 500) == "a\nb\nc"
    assert capsule.skeletonize("function", "rust", "fn f()", None, "fn f() { 1 }") == "fn f() { ... }"
    assert capsule.skeletonize("import", "python", "import x", None, "import x") == "import x"
    big = "class A {\n" + "\n".join(f"  m{i}(x: number): void {{ go(); }}" for i in range(8)) + "\n}"
    assert capsule.skeletonize("class", "typescript", "class A", None, big).count("m") >= 8


def test_packing(spark):
    s = syms(spark, [(i, f"f{i}", "function", f"{i}.py", f"def f{i}():\n" + "    x = 1\n" * n, "python") for i, n in ((1, 10), (2, 400), (3, 5))]).withColumn("docstring", F.lit(None).cast("string"))
    q = spark.createDataFrame([(1, "f1 x", 300)], "query_id long, task string, budget int")
    p = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, place int, id long")
    packed = capsule.pack_pivots(p, s, q)
    rows = {r.id: r for r in packed.collect()}
    assert rows[1].form == "whole" and rows[2].form == "window" and sum(r.tokens for r in rows.values()) <= 255
    out = capsule.summary(packed, capsule.pack_adjacents(packed, p.where("false"), s, q), q).first()
    assert out.total_tokens == 45 + sum(r.tokens for r in rows.values())
    assert "### 1.py::f1" in capsule.render(packed, capsule.pack_adjacents(packed, p.where("false"), s, q), s, q).first().markdown


def test_diff(spark):
    text = "+++ b/a.py\n@@ -1,2 +10,5 @@\n@@ -9 +30 @@ x\n+++ /dev/null\n@@ -1 +0,0 @@\n+++ b/c.py\n@@ -1,0 +7,0 @@\n"
    h = diff.hunks(spark.createDataFrame([(1, text)], "diff_id int, diff string"))
    assert [tuple(r) for r in h.orderBy("file_path", "first").collect()] == [(1, "a.py", 10, 14), (1, "a.py", 30, 30), (1, "c.py", 7, 7)]
    s = spark.createDataFrame([(1, "a.py", 1, 9), (2, "a.py", 14, 20), (3, "a.py", 30, 30), (4, "b.py", 10, 11), (5, "a.py", None, 12)], "id long, file_path string, start_line int, end_line int")
    assert {r.id for r in diff.touched(h, s).collect()} == {2, 3}


# ---- memory and statistics

NOW = dt.datetime(2024, 6, 1)


def observed(spark, rows):
    return spark.createDataFrame(rows, "id string, session_id string, content string, symbol_fqn string, symbol_hash string, created_at timestamp_ntz, is_stale boolean, kind string, expires_at timestamp_ntz")


def test_memory(spark):
    at = lambda h: NOW - dt.timedelta(hours=h)
    o = observed(spark, [
        ("a", "s", "retry logic exists", "f", "H1", at(3), False, "manual", None),
        ("b", "s", "retry backoff is implemented", "f", "h2", at(2), None, "auto", NOW + dt.timedelta(days=1)),
        ("c", "s", "expired retry backoff", "f", None, at(1), False, "auto", NOW),
        ("d", "s", None, "f", "x", at(4), True, "insight", None),
        ("e", "s", "other", "g", "x", at(5), False, "summary", None),
    ])
    q = spark.createDataFrame([(1, "Retry  backoff")], "query_id int, query string")
    assert [(r.id, r.score) for r in memory.search(o, q, NOW).orderBy("place").collect()] == [("b", 2), ("a", 1)]
    assert [r.id for r in memory.prune(o, NOW).collect()] == ["c"] and memory.staleness(o, NOW).first().stale_pct == 25.0
    one = memory.compress(o, NOW).collect()
    assert [(r.symbol_fqn, r.n, r.content) for r in one] == [("f", 3, "[summary of 3 observations] retry backoff is implemented")]
    s = spark.createDataFrame([("f", "h1"), ("f", "h2"), ("z", "q")], "fqn string, content_hash string")
    assert {r.id: r.is_stale for r in memory.mark_stale(o, s).collect()} == {"a": False, "b": False, "c": False, "d": True, "e": False}
    assert [r.id for r in memory.recent(o, NOW, 2).collect()] == ["b", "a"]
    assert memory.session_lines(o, "L1").count() == 5
    assert memory.compress(o.where("false"), NOW).count() == 0


def test_merge_and_consolidate(spark):
    t = memory.merge_texts(['Agent queried: "q1" — pivots: a, b', 'Agent queried: "q2" — pivots: b, c', 'Agent queried: "q1" — pivots: a'])
    assert t == 'Agent queried: "q1"; "q2" — pivots: a, b, c'
    rows = [(str(i), "s", f"t{i}", None, None, NOW - dt.timedelta(hours=9 - i), False, "auto", None) for i in range(4)]
    v = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.99, 0.01]), ("2", [0.0, 1.0]), ("3", [1.0, 0.02])], "id string, embedding array<float>")
    out = memory.consolidate(observed(spark, rows).join(v, "id"), NOW).collect()
    assert [(r.leader, r.n, r.members) for r in out] == [("0", 3, ["0", "1", "3"])]


def test_suppress_and_dead_ends(spark):
    base = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, "t", base + dt.timedelta(minutes=m)) for i, m in enumerate((0, 20, 40, 59, 75))] + [(9, None, base)], "id long, task string, timestamp timestamp_ntz")
    assert sorted(r.id for r in memory.suppress_repeats(log).collect()) == [0, 2, 4]
    ch = spark.createDataFrame([("s", "f", "add", base), ("s", "f", "remove", base + dt.timedelta(minutes=1)), ("s", "g", "remove", base), ("s", "g", "add", base + dt.timedelta(minutes=1))], "session_id string, fqn string, action string, ts timestamp_ntz")
    assert [(r.session_id, r.fqn) for r in memory.dead_ends(ch).collect()] == [("s", "f")]


def test_stats_empty_and_order_statistics(spark):
    log = spark.createDataFrame([(1, NOW, "debug", 100, 1000, x, ["py"]) for x in (5, 1, 9, 7)], "id long, timestamp timestamp_ntz, intent string, total_tokens long, candidate_file_tokens long, latency_ms long, languages_hit array<string>")
    assert tuple(stats.latency(log).first()) == (7, 9)
    assert stats.usage(log).first().saved_pct == 90.0 and stats.usage(log.where("false")).first().n_queries == 0


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in store.upsert(old, new, ["k"], first_wins=True).collect()} == {("a", 1), ("b", 1), ("c", 2)}


# ---- enrichment, streams, settings

def test_enrich(spark):
    s = spark.createDataFrame([(1, "a.rs::T::f", "T::f", "method", "rust", "fn f()", "a.rs", 1, None, None), (2, "b.py::g", "g", "function", "python", "def g() -> int:", "b.py", 4, None, None), (3, "b.py::h", "h", "function", "python", "def h():", "b.py", 9, None, None), (4, "b.py::C", "C", "class", "python", "class C(A, B):", "b.py", 20, None, None)], "id long, fqn string, name string, kind string, language string, signature string, file_path string, start_line int, resolved_type string, source string")
    r = enrich.rust_types(s, spark.createDataFrame([("f", "Short"), ("T::f", "Long"), ("x", "No")], "key string, type string"))
    assert {(x.id, x.resolved_type, x.source) for x in r.where("id = 1").collect()} == {(1, "Long", "rustdoc")}
    rep = spark.createDataFrame([('{"generalDiagnostics":[{"file":"/r/b.py","severity":"information","message":"Type of \\"h\\" is \\"str\\"","range":{"start":{"line":8}}},{"severity":"error"}]}',), ("broken",)], "json string")
    p = {x.id: x.resolved_type for x in enrich.python_types(s, enrich.parse_diagnostics(rep, "/r")).collect()}
    assert p[2] == "int" and p[3] == "str" and p[4] == "A, B" and p[1] is None
    lines = spark.createDataFrame([('{"fqn":"a","resolved_type":"T","line":1}',), ("{",), ('{"fqn":"","resolved_type":"T"}',)], "value string")
    assert enrich.parse_script_facts(lines).count() == 1
    assert enrich.embed(s, "id", "signature", enrich.HashEmbedder(8)).count() == 4


def test_watched(spark):
    paths = {"src/a.py": True, "src/.hidden/a.py": False, "node_modules/x.ts": False, "src/a.bin": False, "README.md": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in df.where(C.watched(F.col("path"))).collect()} == {p for p, ok in paths.items() if ok}


def test_change_stream(spark, tmp_path):
    import json

    from codeweft.sources import extract as E

    src = tmp_path / "in"
    src.mkdir()
    rows = [("a.py", "created", "2024-01-01T00:00:00", "def f():\n    pass\n"), ("a.py", "modified", "2024-01-01T00:01:00", "def g():\n    pass\n"), ("b.py", "removed", "2024-01-01T00:00:00", None), ("x.bin", "created", "2024-01-01T00:00:00", "")]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "ts", "content"), r))) for r in rows))
    old = E.extract(spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "def h():\n    pass\n")], "path string, content string"))
    seen = []

    def apply(batch, _):
        now, before = E and C.reindex(old, batch, E.extract)
        seen.append((sorted(r.name for r in now.collect()), sorted(r.name for r in before.collect())))

    C.start(C.read_changes(spark, str(src)), apply, str(tmp_path / "cp"), interval=None).awaitTermination()
    assert seen == [(["g"], ["f", "h"])]


def test_config(tmp_path):
    (tmp_path / ".codeweft").mkdir()
    f = tmp_path / ".codeweft" / "config.toml"
    f.write_text("[engine]\nbudget = 5\n[memory]\nauto_ttl_days = 0\n[ranking]\ncentrality_k = 0.2\n")
    c = config.load(str(tmp_path))
    assert (c.budget, c.auto_ttl_days, c.centrality_k) == (100, 1, 1.0)
    f.write_text("not toml [")
    assert config.load(str(tmp_path)) == config.Config()


# ---- the whole way

def test_engine(spark):
    from codeweft.api import Engine

    e = Engine(spark, SF)
    fqn = e.nodes.where("kind = 'function'").first().fqn
    assert e.index_status().first().n_symbols > 0
    md = e.run_pipeline(f"fix the error in {fqn.split('::')[-1]}").first().markdown
    assert md.startswith("# fix the error")
    with pytest.raises(LookupError):
        e.get_impact_graph("no::such::symbol")
    assert e.get_impact_graph(fqn).count() >= 0 and e.get_session_context(NOW).count() <= 50


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_in_the_shared_folder(spark):
    from codeweft.plans import materialize as M

    df = spark.range(10).withColumnRenamed("id", "k")
    kept = M.materialize(df, "t")
    bucketed = M.materialize_bucketed(df, "b", "k", 4)
    assert kept.count() == bucketed.count() == 10
    plan = bucketed.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" in kept.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert M.shared_dir(spark) and not M.shared_dir(spark).endswith("/")
    assert M.clear(spark) >= 2
