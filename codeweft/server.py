"""The engine's calls over JSON-RPC on a pair of byte streams.

A message comes either as a header ``Content-Length: N``, an empty line and N bytes, or as one line of JSON; the answer takes
the form of the question. Messages above 10 MB are refused.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from typing import Any, BinaryIO

from pyspark.sql import functions as F

from codeweft.api import Engine

MOST_BYTES = 10 * 1024 * 1024
PARSE_ERROR, UNKNOWN_METHOD, TOOL_ERROR = -32700, -32601, -32603
MOST_ROWS = 500  # a reply is read by a person or a model; it is a report of the top rows


class BadMessage(ValueError):
    """A frame that is too long or no JSON."""


def read_message(stream: BinaryIO) -> tuple[Any, bool] | None:
    """(message, framed by a header) or None at the end."""
    line = stream.readline(MOST_BYTES + 1)
    while line in (b"\n", b"\r\n"):
        line = stream.readline(MOST_BYTES + 1)
    if not line:
        return None
    if not line.lower().startswith(b"content-length:"):
        if len(line) > MOST_BYTES:
            raise BadMessage("message too long")
        return _json(line), False
    try:
        size = int(line.split(b":", 1)[1])
    except ValueError as e:
        raise BadMessage("bad length") from e
    if not 0 <= size <= MOST_BYTES:
        raise BadMessage("message too long")
    while stream.readline(65_536) not in (b"\r\n", b"\n", b""):
        pass
    data = stream.read(size)
    if len(data) < size:
        return None
    return _json(data), True


def _json(data: bytes) -> Any:
    try:
        return json.loads(data)
    except ValueError as e:
        raise BadMessage("no JSON") from e


def write_message(stream: BinaryIO, message: Any, framed: bool) -> None:
    data = json.dumps(message, ensure_ascii=False, default=str).encode("utf-8")
    stream.write(b"Content-Length: %d\r\n\r\n%s" % (len(data), data) if framed else data + b"\n")
    stream.flush()


#: Tools: name -> (arguments that must be there, call).
TOOLS = {
    "run_pipeline": (("task",), lambda e, a: e.run_pipeline(a["task"], a.get("context"), a.get("budget_tokens"), a.get("language"), a.get("file_hint"))),
    "get_context_capsule": (("query",), lambda e, a: e.get_context_capsule(a["query"], budget=a.get("budget_tokens"), min_score=a.get("min_score"), max_pivots=a.get("max_results"))),
    "get_impact_graph": (("symbol_fqn",), lambda e, a: e.get_impact_graph(a["symbol_fqn"], int(a.get("max_depth", 5)), int(a.get("max_results", 100)), bool(a.get("include_tests", True)))),
    "get_skeleton": (("file_path",), lambda e, a: e.get_skeleton(a["file_path"], a.get("max_depth"))),
    "search_logic_flow": (("from_fqn", "to_fqn"), lambda e, a: e.search_logic_flow(a["from_fqn"], a["to_fqn"])),
    "index_status": ((), lambda e, a: e.index_status()),
    "get_session_context": ((), lambda e, a: e.get_session_context(_now(a), a.get("detail_level", "L2"))),
    "search_memory": (("query",), lambda e, a: e.search_memory(a["query"], _now(a), int(a.get("max_results", 10)))),
    "save_observation": (("content",), lambda e, a: e.save_observation(a["content"], a.get("session_id", "server"), _now(a), a.get("symbol_fqn"), write=bool(a.get("write"))).where(F.col("session_id") == a.get("session_id", "server"))),
    "get_diff_capsule": (("diff",), lambda e, a: e.diff_capsule(a["diff"], _now(a), a.get("budget_tokens")) if a.get("text") else e.get_diff_capsule(a["diff"])),
    "generate_module_docs": ((), lambda e, a: e.generate_module_docs(a.get("write_to"))),
    "get_stats": ((), lambda e, a: e.get_stats(_now(a), int(a.get("days", 30)))),
    "submit_lsp_edges": (("edges",), lambda e, a: e.submit_lsp_edges(e.spark.createDataFrame([(x["from_fqn"], x["to_fqn"], x.get("kind", "references")) for x in a["edges"]], "from_fqn string, to_fqn string, kind string"), write=bool(a.get("write")))),
}


def _now(a: dict) -> dt.datetime:
    return dt.datetime.fromisoformat(a["now"]) if a.get("now") else dt.datetime.now(dt.UTC).replace(tzinfo=None)


def answer(engine: Engine, message: Any) -> dict | None:
    """The reply to a request; None for notifications."""
    if not isinstance(message, dict):
        return _error(None, PARSE_ERROR, "no request")
    key, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if key is None:
        return None
    if method == "initialize":
        return _ok(key, {"serverInfo": {"name": "codeweft"}, "capabilities": {"tools": {}}})
    if method == "ping":
        return _ok(key, {})
    if method in ("resources/list", "resources/templates/list", "prompts/list"):
        return _ok(key, {{"resources/list": "resources", "resources/templates/list": "resourceTemplates", "prompts/list": "prompts"}[method]: []})
    if method == "tools/list":
        return _ok(key, {"tools": [{"name": n, "inputSchema": {"type": "object", "required": list(need)}} for n, (need, _) in TOOLS.items()]})
    if method != "tools/call":
        return _error(key, UNKNOWN_METHOD, f"unknown method {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return _error(key, UNKNOWN_METHOD, f"unknown tool {name}")
    need, call = TOOLS[name]
    missing = [n for n in need if n not in args]
    if missing:
        return _error(key, TOOL_ERROR, f"missing {', '.join(missing)}")
    try:
        got = call(engine, args)
        parts = got if isinstance(got, dict) else {"": got}
        rows = [({"section": k} if k else {}) | r.asDict(recursive=True) for k, df in parts.items() for r in df.limit(MOST_ROWS).collect()]
    except Exception as e:  # noqa: BLE001 - whatever goes wrong is told to the caller
        return _error(key, TOOL_ERROR, str(e)[:500])
    return _ok(key, {"content": [{"type": "text", "text": json.dumps(rows, ensure_ascii=False, default=str)}]})


def _ok(key: Any, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": key, "result": result}


def _error(key: Any, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}


def serve(engine: Engine, source: BinaryIO, sink: BinaryIO) -> None:
    """Answers until the source ends."""
    while True:
        try:
            got = read_message(source)
        except BadMessage as e:
            write_message(sink, _error(None, PARSE_ERROR, str(e)), False)
            continue
        if got is None:
            return
        reply = answer(engine, got[0])
        if reply is not None:
            write_message(sink, reply, got[1])


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    serve(Engine(SparkSession.builder.appName("codeweft").getOrCreate(), sys.argv[1]), sys.stdin.buffer, sys.stdout.buffer)
