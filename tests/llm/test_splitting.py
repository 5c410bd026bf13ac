import random

import pytest

from codeweft.llm.splitting import split_oversized, split_text


def check(body, limit, **kw):
    data = body.encode()
    pieces = split_text(body, limit, **kw)
    assert pieces[0][0] == 0 and pieces[-1][2] == len(data)
    for (s, c, e, a, b), nxt in zip(pieces, pieces[1:] + [None]):
        assert (e - s) // 4 <= limit and s <= c < e
        data[s:e].decode("utf-8")
        assert a == data.count(b"\n", 0, s) and b == a + data.count(b"\n", s, max(s, e - 1))
        if nxt:
            assert nxt[1] == e and nxt[0] < e
    return pieces


def test_lines_share_two():
    body = "".join(f"line {i} is here;\n" for i in range(500))
    pieces = check(body, 200)
    data = body.encode()
    assert len(pieces) > 5
    for p in pieces[1:]:
        assert data[p[0] : p[1]].count(b"\n") == 2


def test_prefers_blank_lines():
    body = "\n".join("\n".join(f"    x{i}_{j} = {j}" for j in range(20)) + "\n" for i in range(12))
    data = body.encode()
    for p in check(body, 120)[1:]:
        assert data[: p[1]].endswith(b"\n\n")


def test_single_line_and_random():
    for p in check("a,b;" * 4000, 300)[1:]:
        assert p[1] - p[0] == 80
    check("é" * 9000, 100)
    rng = random.Random(3)
    for _ in range(60):
        body = "".join(rng.choice(["ab ", "x;", "\n", "\n\n", "\t", "ü", "日", "y" * 50, "\r\n"]) for _ in range(rng.randrange(200, 3000)))
        check(body, rng.choice([50, 100, 333]))


@pytest.mark.parametrize("body", ["", "x", "y" * 4003])
def test_small_is_one_piece(body):
    assert len(split_text(body)) == 1


def test_operator(spark):
    rows = [(1, None, 1, "a"), (2, "", 1, "a"), (3, "x\n" * 3000, None, "a"), (3, "x\n" * 3000, None, "a"), (4, "x\n" * 3000, 11, "a"), (5, "z" * 4003, 1, "a"), (6, "z" * 4004, 1, "a")]
    df = spark.createDataFrame(rows, "id long, body string, start_line int, piece string")
    out = split_oversized(df).collect()
    assert {r.id for r in out} == {3, 4, 6}
    first = {r.id: r for r in out if r.piece == 0}
    last = {r.id: r for r in out if r.piece == r.n_pieces - 1}
    assert first[3].start_line == 1 and first[4].start_line == 11 and last[4].end_line == 3010
    assert all(r.n_tokens <= 1000 for r in out) and len(out) == len({(r.id, r.piece) for r in out})
    assert split_oversized(df.where("false")).count() == 0
