import io
import json

import pytest
from conftest import SF

from codeweft import server as S


def test_frames():
    body = json.dumps({"id": 1, "method": "ping", "ü": "é"}, ensure_ascii=False).encode()
    framed = b"Content-Length: %d\r\n\r\n%s" % (len(body), body)
    s = io.BytesIO(framed + body + b"\n\n" + framed)
    got = [S.read_message(s) for _ in range(4)]
    assert [g and g[1] for g in got] == [True, False, True, None] and got[0][0]["ü"] == "é"
    out = io.BytesIO()
    S.write_message(out, {"a": "é"}, True)
    out.seek(0)
    assert S.read_message(out) == ({"a": "é"}, True)
    for bad in (b"{\n", b"Content-Length: x\r\n\r\n", b"Content-Length: 99999999999\r\n\r\n"):
        with pytest.raises(S.BadMessage):
            S.read_message(io.BytesIO(bad))


def test_protocol(spark):
    from codeweft.api import Engine

    e = Engine(spark, SF)
    ask = lambda method, params=None, key=1: S.answer(e, {"id": key, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "codeweft" and ask("ping")["result"] == {}
    assert len(ask("tools/list")["result"]["tools"]) == 13 and ask("prompts/list")["result"] == {"prompts": []}
    assert ask("nope")["error"]["code"] == S.UNKNOWN_METHOD and S.answer(e, {"method": "initialized"}) is None
    assert ask("tools/call", {"name": "get_impact_graph", "arguments": {"symbol_fqn": "x::y"}})["error"]["code"] == S.TOOL_ERROR
    assert ask("tools/call", {"name": "search_memory"})["error"]["code"] == S.TOOL_ERROR
    rows = json.loads(ask("tools/call", {"name": "index_status"})["result"]["content"][0]["text"])
    assert rows[0]["n_symbols"] > 0
    src, sink = io.BytesIO(b'{"id": 1, "method": "ping"}\nbroken\n'), io.BytesIO()
    S.serve(e, src, sink)
    lines = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert lines[0]["result"] == {} and lines[1]["error"]["code"] == S.PARSE_ERROR
