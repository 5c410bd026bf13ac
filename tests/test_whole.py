"""Queries over the whole of a table, beside those whose SQL states a part."""

import datetime as dt

from codeweft.catalogue import CORE
from codeweft.operators import stats
from codeweft.plans import more_queries, report_queries


def test_x04_all_documents(spark, monkeypatch):
    frame = 'File "a.py", line 3, in '
    texts = [frame + "load_rows\nin a while", frame + "<module>\n" + frame + "run_all", frame + "go\n", frame + "print\n", "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(more_queries, "table", lambda *a: docs)
    assert {r.doc_id: r.n for r in CORE.queries["x04_frames_all"](spark, "").collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_reports_take_the_whole_log(spark, monkeypatch):
    at = dt.datetime(2024, 9, 1)
    times = [at - dt.timedelta(days=9), at, at + dt.timedelta(days=9), None]
    log = spark.createDataFrame([(i, t, "debug", 100, 1000, i, ["py"]) for i, t in enumerate(times)], "id long, timestamp timestamp_ntz, intent string, total_tokens long, candidate_file_tokens long, latency_ms long, languages_hit array<string>")
    monkeypatch.setattr(report_queries, "query_log", lambda *a: log)
    monkeypatch.setattr(report_queries, "symbols", lambda *a: spark.createDataFrame([("x" * 4000,)], "body string"))
    one = lambda n: CORE.queries[f"{n}_all"](spark, "").first()
    assert one("a02_usage").n_queries == one("a04_intents").n == one("a05_languages").n == 4
    assert one("a03_latency").p95 == 3 and one("a06_workspace_savings").avg_tokens == 100
    assert [r.id for r in stats.since(log, at, 5).orderBy("id").collect()] == [1, 2]
