"""The engine over a copy of the smallest tables: text where a person reads it, and writes."""

import datetime as dt
import os
import shutil

import pytest
from conftest import SF
from pyspark.sql import functions as F

from codeweft.api import Engine
from codeweft.operators import capsule, enrich, memory
from codeweft.streaming.changes import fold_batch

NOW = dt.datetime(2024, 9, 1)


@pytest.fixture()
def engine(spark, tmp_path):
    folder = str(tmp_path / "ws")
    shutil.copytree(SF, folder)
    os.chmod(folder, 0o755)
    return Engine(spark, folder, embedder=enrich.HashEmbedder())


def test_capsule_has_all_halves(engine):
    last = engine.table("observations").where("content IS NOT NULL").orderBy("created_at").first()
    text = engine.run_pipeline(f"fix {last.content}", now=NOW - dt.timedelta(days=400), max_pivots=3).collect()[0].markdown
    assert "```" in text and "## Related" in text and "## Memory" in text
    assert engine.vectors.count() == engine.symbols.where("kind IS NOT NULL AND NOT is_stub").count()


def test_impact_and_diff_texts(engine):
    to = engine.index.link.groupBy("to_id").count().orderBy("count", ascending=False).select("to_id").collect()
    hub = next(s for r in to for s in [engine.symbols.where(f"id = {r.to_id} AND fqn IS NOT NULL").first()] if s)
    text = engine.impact_text(hub.fqn, max_results=2)
    assert text.startswith(f"## Impact graph: {hub.fqn}") and "(2 shown" in text and "Total affected: " in text
    f = engine.symbols.where("kind = 'function' AND end_line >= start_line AND leaf_name IS NOT NULL AND body IS NOT NULL").first()
    diff = f"--- a/{f.file_path}\n+++ b/{f.file_path}\n@@ -1 +{f.start_line} @@\n"
    assert f.leaf_name in engine.diff_capsule(diff, NOW).collect()[0].markdown.splitlines()[0]


def test_writes(engine, tmp_path):
    n = engine.table("observations").count()
    engine.save_observation("kept", "s1", NOW, write=True)
    engine.save_observation("kept", "s1", NOW, write=True)
    rows = engine.table("observations").where("content = 'kept'").collect()
    assert len(rows) == 1 and engine.table("observations").count() <= n + 1
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def foo():\n    return bar(1)\n\n\ndef bar(x):\n    return x + 1\n")
    engine.index_workspace(str(tmp_path / "src"), write=True)
    names = {r.fqn for r in engine.symbols.collect()}
    assert {"a.py::foo", "a.py::bar"} == names
    assert [(r.kind) for r in engine.table("edges").collect()] == ["calls"]
    pushed = engine.spark.createDataFrame([("a.py::foo", "a.py::bar", "extends"), ("a.py::foo", "no.py::x", "calls")], "from_fqn string, to_fqn string, kind string")
    engine.submit_lsp_edges(pushed, write=True)
    engine.submit_lsp_edges(pushed, write=True)
    assert sorted(r.kind for r in engine.table("edges").collect()) == ["calls", "inherits"]


def test_memories_fit_the_reserve(spark):
    obs = spark.createDataFrame([(1, i, str(i), "x" * 100, NOW, None, i == 2) for i in range(1, 5)], "query_id int, place int, id string, content string, created_at timestamp_ntz, symbol_fqn string, is_stale boolean")
    q = spark.createDataFrame([(1, "t", 400)], "query_id int, task string, budget int")
    assert [r.place for r in capsule.pack_memories(obs, q).orderBy("place").collect()] == [1, 2]


def test_swift_hint_and_long_paths(spark):
    from codeweft.operators import graph

    s = spark.createDataFrame([(1, "a", "swift", "f()", "x.swift"), (2, "b", "python", "g()", "y.py")], "id long, fqn string, language string, signature string, file_path string")
    q = spark.createDataFrame([(1, "t"), (2, "u")], "query_id int, task string")
    full = spark.createDataFrame([(1, 1, 1, "body"), (2, 1, 2, "body")], "query_id int, place int, id long, text string")
    brief = full.where("false").select("query_id", "place", "id")
    got = {r.query_id: r.markdown for r in capsule.render(full, brief, s, q).collect()}
    assert capsule.SWIFT_HINT in got[1] and capsule.SWIFT_HINT not in got[2]
    link = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 50)], "from_id long, to_id long")
    pairs = spark.createDataFrame([(0, 20), (0, 50), (5, 5), (20, 0)], "from_id long, to_id long")
    paths = {(r.from_id, r.to_id): r.path for r in graph.shortest_paths(link, pairs).collect()}
    assert paths == {(0, 20): list(range(21)), (0, 50): [0, 50], (5, 5): [5]}


def test_suppression_streams_a_hot_task(spark):
    t = [NOW + dt.timedelta(minutes=m) for m in (0, 10, 29, 30, 31, 59, 60, 95)]
    log = spark.createDataFrame([(i, "a", x) for i, x in enumerate(t)] + [(90, "b", t[0]), (91, None, t[0]), (92, "b", None)], "id long, task string, timestamp timestamp_ntz")
    assert sorted(r.id for r in memory.suppress_repeats(log).collect()) == [0, 3, 6, 7, 90]
    c = spark.createDataFrame([("p", "created", t[0]), ("p", "removed", t[1]), ("q", "created", t[0])], "path string, kind string, ts timestamp_ntz")
    assert sorted((r.path, r.kind, r.n) for r in fold_batch(c).collect()) == [("p", "removed", 2), ("q", "created", 1)]


def test_changes_run_through(engine, tmp_path):
    import json

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def foo():\n    return bar_one(1)\n\n\ndef gone():\n    return 2\n")
    (src / "b.py").write_text("def bar_one(x):\n    return x + 1\n")
    (src / "c.py").write_text("def unused(x):\n    return x + 1\n")
    engine.index_workspace(str(src), write=True)
    foo = engine.symbols.where("fqn = 'a.py::foo'").first()
    engine.save(observations=engine.table("observations").limit(1).withColumns({"symbol_fqn": F.lit("a.py::foo"), "symbol_hash": F.lit(foo.content_hash), "is_stale": F.lit(False), "id": F.lit("o")}))
    drop = tmp_path / "changes"
    drop.mkdir()
    at = lambda s: f"2024-09-01T10:00:{s:02d}"
    rows = [("a.py", "modified", at(i), f"def foo():\n    return bar_one({i})\n\n\ndef fresh():\n    return foo()\n") for i in range(4)] + [("c.py", "removed", at(9), None), (".git/x.py", "modified", at(1), "def no(): pass")]
    (drop / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "ts", "content"), r))) for r in rows))
    engine.watch(str(drop), str(tmp_path / "state")).awaitTermination()
    assert {r.fqn for r in engine.symbols.collect()} == {"a.py::foo", "a.py::fresh", "b.py::bar_one"}
    names = engine.symbols.select("id", "fqn")
    links = engine.table("edges").join(names.withColumnsRenamed({"id": "from_id", "fqn": "f"}), "from_id").join(names.withColumnsRenamed({"id": "to_id", "fqn": "t"}), "to_id")
    assert {(r.f, r.t) for r in links.collect()} == {("a.py::foo", "b.py::bar_one"), ("a.py::fresh", "a.py::foo")}
    obs = {r.kind if r.id != "o" else "o": r for r in engine.table("observations").collect()}
    assert obs["o"].is_stale and set(obs) == {"o", "passive", "file_thrash"}
    assert obs["passive"].change_category == "new_symbol" and "a.py::fresh" in obs["passive"].content and "4 times" in obs["file_thrash"].content
    assert {r.path for r in engine.table("files").collect()} == {"a.py", "b.py"}


def test_postings_change_nothing(engine):
    from codeweft.operators import bm25

    q = engine.spark.createDataFrame([(i, t) for i, t in enumerate(["load the rows of the trail", "budget lattice", "zzz none", ""])], "query_id long, task string")
    s = engine.index.symbols
    rows = lambda built: sorted(map(tuple, bm25.search(s, q, built=built).collect()))
    assert rows(None) == rows(engine.index.postings) and rows(None)
