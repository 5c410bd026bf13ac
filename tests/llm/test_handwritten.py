import random

import pytest

from codeweft.llm import handwritten as H


@pytest.mark.parametrize(
    "comment,expected",
    [
        ("// Code generated by kilnc 1.2.3. DO NOT EDIT.\n", (True, False, False)),
        ("/*\n * @generated from schema/a.idl\n */\n", (True, False, False)),
        ("# Ce fichier est généré ; ne pas modifier (beacon)\n", (True, False, False)),
        ("// Hand-tuned; the generated variant was slower.\n", (False, False, True)),
        ("// mossrunner v1.4.0 | (c) the mossrunner authors | MIT License\n", (False, True, False)),
        ("# third-party source: moltark-3.16.1.tar.gz\n", (False, True, False)),
        ("// Part of this workspace; licence text in LICENSE.\n", (False, False, True)),
        ("/** Merges the plain stage. */\n", (False, False, False)),
    ],
)
def test_notices(comment, expected):
    assert H.notice(H.leading_comment(comment + "fn x() {}")) == expected
    assert H.leading_comment('out.push("// Code generated by x. DO NOT EDIT.");') == ""


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["zone", "plan", "edge", "lane", "page", "role"]) + rng.choice(["Map", "Set", "Unit", "Port"])
    rows, truth = [], {}
    for r in range(30):
        repo = f"ws{r:03d}"
        for f in range(12):
            path = f"{repo}/src/{word()}/{word()}{f}.js"
            truth[path] = None
            for k in range(4):
                rows.append((path, False, f"function {word()}({word()}) {{\n  // {word()} {word()}\n  if (!{word()}.{word()}) {{\n    return {word()}({rng.randrange(99)});\n  }}\n}}", "function"))
        path = f"{repo}/static/{word()}.min.js"
        truth[path] = "minified"
        rows.append((path, False, "".join(f"function {chr(97 + i % 26)}(e){{return e.{word()}?{i}:q}}" for i in range(60)), "function"))
        path = f"{repo}/src/gen/{word()}.js" if r % 2 else f"{repo}/src/{word()}/{word()}_api.js"
        truth[path] = "generated"
        for k in range(4):
            head = "// Code generated by kilnc 1.0.0. DO NOT EDIT.\n\n" if k == 0 and r % 3 else ""
            rows.append((path, False, f"{head}get{word()}() {{\n  return this.slots_[{k}].cast({word()}, {rng.randrange(999)}, 0x{rng.randrange(1 << 31, 1 << 32):08x});\n}}", "method"))
        path = f"{repo}/src/assets/{word()}.js"
        truth[path] = "data"
        rows.append((path, False, "export const X = [\n" + "".join("    " + ", ".join(str(rng.randrange(9999)) for _ in range(10)) + ",\n" for _ in range(30)) + "];", "constant"))
        path = f"{repo}/node_modules/@types/lathe/{word()}.d.ts"
        truth[path] = "vendored"
        rows.append((path, True, f"{word()}(a: {word()}): {word()};", "function"))
    return rows, truth


def test_classify(spark):
    rows, truth = corpus()
    rows = rows + rows[:20] + [(None, False, "x", "function"), ("ws000/src/empty.js", None, None, None), ("ws000/src/empty.js", False, "", "function")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "file_path string, is_stub boolean, body string, kind string, margin double")
    model, report = H.fit_on(df)
    got = {r.file_path: r.kind for r in H.classify(df, model).collect()}
    assert got.pop("ws000/src/empty.js") is None
    wrong = [p for p in truth if (truth[p] is None) != (got[p] is None)]
    assert not wrong
    assert all(hit >= 0.8 * n for n, hit, _ in report.values())
    assert H.classify(df.where("false"), model).count() == 0
    empty_model, _ = H.fit_on(df.where("false"))
    assert H.classify(df, empty_model).where("kind IS NOT NULL").count() == 0


def test_what_decides(spark):
    rows, truth = corpus(5)
    df = spark.createDataFrame(rows, "file_path string, is_stub boolean, body string, kind string")
    model, _ = H.fit_on(df)
    made = [p for p, k in truth.items() if k]
    found = lambda m: sum(r.kind is not None for r in H.classify(df, m).collect() if r.file_path in set(made))
    assert found(model) >= 0.95 * len(made)
    without = H.Model(0 * model.gram, 0 * model.comment, model.path, model.share, model.bias, {})
    assert found(without) < 0.7 * len(made)
    hidden = [("ws900/x/" + p.replace("/", "_"), s, b[len(H.leading_comment(b)) :], k) for p, s, b, k in rows if truth[p] in ("minified", "data", "generated")]
    alone = H.classify(spark.createDataFrame(hidden, df.schema), model).where("kind IS NOT NULL").count()
    assert alone >= 0.9 * len({h[0] for h in hidden})


def test_comment_grams_add_up():
    import numpy as np

    a, b = "// Generated by tool 1.2.3\n// do not edit\n", "/** Merges. */"
    w = np.random.default_rng(1).random((H.COMMENT_HASHED, 4))
    both = H.comment_scores([a, b, "", a + b], w)
    assert np.allclose(both[0] + both[1], both[3]) and not both[2].any()
    assert np.allclose(H.comment_scores(["// Generated by tool 77.1.0\n// do not edit\n"], w)[0], both[0])
    h, _, c = H.comment_grams([a])
    assert abs(sum(c**2) - 2) < 1e-9  # one per line
