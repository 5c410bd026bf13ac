import pytest

from codeweft.sources import extract as X


def names(found):
    return [(f.kind, f.name) for f in found]


def test_python():
    src = 'from a import b\n\n@deco\nclass Foo(pkg.Base):\n    """Doc."""\n    def __init__(self):\n        pass\n\n    async def bar(self, x: int) -> str:\n        def inner():\n            pass\n\n\ndef greet(name: str) -> str:\n    """Say hello."""\n    return name\n'
    found = X.python(src)
    assert names(found) == [("import", "from a import b"), ("class", "Foo"), ("method", "Foo::__init__"), ("async_method", "Foo::bar"), ("method", "Foo::inner"), ("function", "greet")]
    by = {f.name: f for f in found}
    assert by["Foo"].start == 3 and by["Foo"].signature == "class Foo(pkg.Base):" and by["Foo"].docstring == "Doc."
    assert by["greet"].docstring == "Say hello." and by["greet"].signature == "def greet(name: str) -> str:"
    assert ("function", "broken") in names(X.python("def broken(:\n    x = 1\n"))


def test_script():
    src = 'import { A } from "./a";\n/** Adds. */\nexport async function add(a: number) {\n  return "}" + a;\n}\nexport class Box<T> {\n  private size(): number { return 1; }\n  async load(x) {\n    if (x) { go(); }\n  }\n}\ninterface Shape { area(): number; }\nexport type Id = string;\nenum Color { Red }\nconst f = (x) => { return x; };\n'
    got = names(X.script(src))
    for want in [("async_function", "add"), ("class", "Box"), ("method", "Box::size"), ("async_method", "Box::load"), ("interface", "Shape"), ("type_alias", "Id"), ("enum", "Color"), ("function", "f")]:
        assert want in got
    assert not any(n.endswith("::if") for _, n in got)
    assert next(f for f in X.script(src) if f.name == "add").docstring == "/** Adds. */"


def test_rust():
    src = "use a::{b, c};\npub struct User { id: u64 }\nimpl Show for User {\n    /// Shows.\n    pub fn show(&self) -> String { format!(\"{}\", self.id) }\n}\npub trait Show { fn show(&self) -> String; }\nenum E { A }\nmod inner;\npub async fn run(x: u8) -> Result<()> {\n    Ok(())\n}\n"
    got = names(X.rust(src))
    for want in [("struct", "User"), ("impl", "impl::Show for User"), ("function", "User::show"), ("trait", "Show"), ("enum", "E"), ("module", "mod::inner"), ("function", "run")]:
        assert want in got


def test_swift():
    src = "import Foundation\npublic class Car {\n    init(x: Int) { }\n    func drive() async throws -> Int { return 1 }\n}\nextension Car {\n    func stop() { }\n}\nprotocol Runs { }\nfunc top(a: Int) { }\n"
    got = names(X.swift(src))
    for want in [("import", "Foundation"), ("class", "Car"), ("async_method", "Car::drive"), ("method", "Car::stop"), ("interface", "Runs"), ("function", "top"), ("method", "Car::init")]:
        assert want in got


def test_line_languages():
    assert names(X.shell("# doc\nfoo() {\n  echo \"}\"\n}\nfunction bar {\n  foo\n}\n")) == [("function", "foo"), ("function", "bar")]
    assert names(X.html("<p>\n<script>x()</script>\n<style>a{}</style>")) == [("script_block", "script@2"), ("style_block", "style@3")]
    assert names(X.sql("CREATE TABLE app.users (id INT);\ncreate or replace function f() returns void as $$ begin; end $$ language sql;\nCREATE VIEW v AS SELECT 1;")) == [("struct", "users"), ("function", "f"), ("type_alias", "v")]
    md = X.markdown("# A\ntext\n## B\nmore\n# C\n\nSet\n---\nx\n```\n# no\n```\n")
    assert names(md) == [("module", "A"), ("module", "B"), ("module", "C"), ("module", "Set")] and md[0].end == 4


@pytest.mark.parametrize("lang", list(X.EXTRACTORS))
@pytest.mark.parametrize("text", ["", "\n\n", "é日本 {{{ ((( \"", "def f(", "/* never closed", "<script>"])
def test_odd_input(lang, text):
    X.EXTRACTORS[lang](text)


def test_tables(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "src" / "secret_keys.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("function g() {}\n")
    files = X.scan(spark, str(tmp_path))
    rows = X.extract(files).collect()
    assert [(r.file_path, r.name, r.fqn) for r in rows] == [("src/a.py", "f", "src/a.py::f")]
    assert X.extract(files.where("false")).count() == 0
