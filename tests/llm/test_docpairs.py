import pytest

from codeweft.llm.docpairs import bare, comment_in_body, documented, normal_signature, pairs, parameter_types, says_something

NOTHING = [
    ("", "f", "def f():"), ("   ", "f", ""), ("/** */", "f", ""), ("///", "f", ""), ("-----", "f", ""), ("TODO", "f", ""), ("TODO: somebody please write a description", "f", ""), ("Missing documentation", "f", ""),
    ("@inheritdoc", "f", ""), ("{@inheritDoc}", "f", ""), ("See base class.", "f", ""), ("noqa: E501", "f", ""), ("eslint-disable-next-line no-unused-vars", "f", ""), ("rustfmt::skip", "f", ""), ("Overrides the parent method.", "f", ""),
    ("Queue the channel graph.", "queue_channel_graph", "def queue_channel_graph(a):"), ("This method scans lattice.", "scan_lattice", ""), ("MERGE QUIET DELTA!", "mergeQuietDelta", ""), ("mergeQuietDelta()", "mergeQuietDelta", ""),
    ("Takes leftSide. Returns BigUnit.", "run", "run(leftSide): BigUnit {"), (":param a:\n:returns:", "f", "def f(a):"), ("@param {Type} value", "f", "f(value)"), ("- Parameter x:\n- Returns:", "f", "func f(x: Int)"), ("* `x`\n* `y`", "f", "fn f(x: u8, y: u8)"),
    ("Copyright (c) 2020 the authors. All rights reserved.", "f", ""), ("Code generated by tool. DO NOT EDIT.", "f", ""), ("Filler text, filler text, still to be replaced.", "f", ""), ("_summary_", "f", ""), ("MARK: -", "f", ""), ("arg:\nReturns:", "f", ""),
]
SOMETHING = [
    ("Not thread-safe.", "f", ""), ("May return null.", "f", ""), ("Counts from one.", "f", ""), ("TODO: tidy up.\nCaller owns the lock.", "f", ""), ("Läuft nur einmal pro member.", "f", ""), ("最後に読み込んだ値を返します。", "f", ""), ("Возвращает копию записи.", "f", ""),
    (":param a: where the count begins\n:returns:", "f", "def f(a):"), ("/** Blocks until the queue drains. */", "f", ""), ("// Helper for f: stops after three tries.", "f", ""), ("F: guards against overflow.", "f", ""), ("* `x` - where the path begins", "f", "fn f(x: u8)"),
]


@pytest.mark.parametrize("doc,name,sig", NOTHING)
def test_nothing(doc, name, sig):
    assert says_something(doc, name, sig) is None


@pytest.mark.parametrize("doc,name,sig", SOMETHING)
def test_something(doc, name, sig):
    assert says_something(doc, name, sig)


def test_places():
    assert bare(comment_in_body("/**\n * Stops early.\n */\nfunction f() {}", "javascript")) == "Stops early."
    assert comment_in_body("// Banner text here\n\nfunction f() {}", "javascript") is None
    assert comment_in_body("/// A.\n/// B.\n#[inline]\npub fn f() {}", "rust") == "/// A.\n/// B."
    assert comment_in_body("function f() {\n  // inside\n}", "typescript") is None
    assert comment_in_body('async def f(a: str = ")",\n      b=1) -> dict[str, int]:\r\n    """Keeps order."""\r\n    pass', "Python") == "Keeps order."
    assert comment_in_body("# above\ndef f():\n    return 1", "python") is None
    assert comment_in_body("-- Sums up.\nCREATE FUNCTION f()", "sql") == "-- Sums up." and comment_in_body("f() { :; }", "shell") is None
    assert comment_in_body("", "rust") is None and comment_in_body("/* never", "rust") is None


def test_signatures():
    assert normal_signature("def f(self, a: int = 3, *args, b=(1, 2)) -> X:") == normal_signature("f(a: number, args, b)") == "a,args,b"
    assert normal_signature("fn f(&self, mut x: Vec<(u8, u8)>)") == "x" and normal_signature(None) == ""


def test_operator(spark):
    cols = "id long, name string, file_path string, kind string, signature string, docstring string, body string, language string, is_stub boolean, origin string"
    rows = [
        (1, "C::f", "ws1/a.py", "fn", "def f(self, a):", "Keeps order.", "def f(self, a):\n    pass", "Python", None, "x"),
        (1, "C::f", "ws1/a.py", "fn", "def f(self, a):", "Keeps order.", "def f(self, a):\n    pass", "Python", None, "x"),
        (2, "C::g", "ws1/a.py", "method", "def g(self, a, b):", None, "def g(self, a, b):\n    pass", "python", False, "x"),
        (3, "C::g", "ws1/a.pyi", "method", "def g(self, a: int, b: int) -> int: ...", "Rounds towards zero.", "def g(self, a: int, b: int) -> int: ...", "python", True, "x"),
        (4, "C::g", "ws1/a.pyi", "method", "def g(self, a: str) -> str: ...", "Pads on the left.", "...", "python", True, "x"),
        (5, "h", "ws1/a.py", "function", None, None, None, None, None, "x"),
        (6, "h", "ws1/a.py", "function", "def h():", "", 'def h():\n    """Real text."""', "python", False, "x"),
        (7, "K", "ws1/a.py", "class", "class K:", "Real text.", "class K: pass", "python", False, "x"),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    assert [r.id for r in documented(df).collect()] == [1]
    got = {r.id: (r.origin, r.description) for r in pairs(df).collect()}
    assert got == {1: ("docstring", "Keeps order."), 2: ("declaration", "Rounds towards zero.")}
    assert pairs(df.where("false")).count() == 0


def test_overloads_by_type(spark):
    cols = "id long, name string, file_path string, kind string, signature string, docstring string, body string, language string, is_stub boolean"
    rows = [
        (1, "C::f", "ws1/a.ts", "method", "f(a: number)", None, "f(a: number) { }", "typescript", False),
        (2, "C::f", "ws1/a.ts", "method", "f(a: string)", None, "f(a: string) { }", "typescript", False),
        (3, "C::f", "ws1/a.d.ts", "method", "f(a: number)", "Rounds towards zero.", None, "typescript", True),
        (4, "C::f", "ws1/a.d.ts", "method", "f(a: string)", "Pads on the left.", None, "typescript", True),
        (5, "C::g", "ws1/a.ts", "method", "g(a: number)", None, "g(a: number) { }", "typescript", False),
        (6, "C::g", "ws1/a.d.ts", "method", "g(a: number)", "TODO", None, "typescript", True),
        (7, "C::g", "ws1/a.d.ts", "method", "g(a: string)", "Pads on the left.", None, "typescript", True),
        (8, "C::h", "ws1/a.ts", "method", "h(a)", None, "h(a) { }", "typescript", False),
        (9, "C::h", "ws1/a.d.ts", "method", "h(a: string)", "Pads on the left.", None, "typescript", True),
    ]
    got = {r.id: r.description for r in pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: "Rounds towards zero.", 2: "Pads on the left.", 8: "Pads on the left."}


def test_arrow_types():
    assert normal_signature("f(a: (x: number) => void, b: number)") == "a,b" and parameter_types("f(a?: number = 3, b, c: () => void)") == ["number", "", "()=>void"]


def test_found_reads_pairs(spark, monkeypatch):
    from codeweft.llm import docpairs, docpairs_queries

    monkeypatch.setattr(docpairs_queries, "table", lambda *a: None)
    monkeypatch.setattr(docpairs, "pairs", lambda _: spark.createDataFrame([(1, "docstring"), (2, "body"), (3, "declaration")], "id long, origin string"))
    assert sorted(r.id for r in docpairs_queries.p3_found(spark, "").collect()) == [1, 2]


@pytest.mark.parametrize(
    "doc,said",
    [
        ("Takes raw_epoch, owner. Returns ColumnReport.", False),
        ("A method called commit which commits and returns DraftCommit.", False),
        ("commit: takes no arguments and returns a NestedTicket.", False),
        ("Returns the ColumnReport of the last hour.", True),
        ("Not thread-safe.", True),
        ("Zählt ab eins.", True),
    ],
)
def test_names_of_types_are_no_words(doc, said):
    assert bool(says_something(doc, "commit", "def commit(self, raw_epoch, owner):")) is said
