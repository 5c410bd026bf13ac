"""Symbols from source text, one row per symbol, for a table of files.

Python is parsed with the standard ``ast`` module, HTML, Markdown, SQL and shell by line rules, and the brace languages by a
scanner that knows strings, comments and nesting. A file that cannot be parsed gives what the line rules find. Files are
independent, so the work is one pass over the table without a shuffle.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import EXTENSIONS
from codeweft.sources import walk


@dataclass
class Found:
    kind: str
    name: str
    start: int
    end: int
    signature: str
    docstring: str | None
    body: str


def python(source: str) -> list[Found]:
    """Functions, methods, classes and imports; names are qualified by the innermost enclosing class."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(source)
    lines = source.splitlines()
    out: list[Found] = []

    def text(a: int, b: int) -> str:
        return "\n".join(lines[a - 1 : b])

    def doc(node: ast.AST) -> str | None:
        return ast.get_docstring(node, clean=False)

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                returns = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                base = "method" if owner else "function"
                kind = f"async_{base}" if isinstance(child, ast.AsyncFunctionDef) else base
                name = f"{owner}::{child.name}" if owner else child.name
                out.append(Found(kind, name, first, child.end_lineno, f"def {child.name}({ast.unparse(child.args)}){returns}:", doc(child), text(first, child.end_lineno)))
                walk(child, owner)
            elif isinstance(child, ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                bases = ", ".join(ast.unparse(b) for b in [*child.bases, *child.keywords])
                out.append(Found("class", child.name, first, child.end_lineno, f"class {child.name}({bases}):" if bases else f"class {child.name}:", doc(child), text(first, child.end_lineno)))
                walk(child, child.name)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                t = text(child.lineno, child.end_lineno).strip()
                out.append(Found("import", t, child.lineno, child.end_lineno, t, None, t))
            else:
                walk(child, owner)

    walk(tree, None)
    return out


_PY_LINE = re.compile(r"^(\s*)(async\s+)?(def|class)\s+(\w+)")


def _python_lines(source: str) -> list[Found]:
    lines, out = source.splitlines(), []
    for i, line in enumerate(lines):
        m = _PY_LINE.match(line)
        if m:
            depth, j = len(m.group(1).expandtabs()), i + 1
            while j < len(lines) and (not lines[j].strip() or len(lines[j].expandtabs()) - len(lines[j].expandtabs().lstrip()) > depth):
                j += 1
            while j > i + 1 and not lines[j - 1].strip():
                j -= 1
            kind = "class" if m.group(3) == "class" else ("async_function" if m.group(2) else "function")
            out.append(Found(kind, m.group(4), i + 1, j, line.strip(), None, "\n".join(lines[i:j])))
        elif re.match(r"\s*(?:from\s+\S+\s+import|import)\s", line):
            out.append(Found("import", line.strip(), i + 1, i + 1, line.strip(), None, line.strip()))
    return out


def _blank(source: str, hash_comments: bool = False, raw_quotes: str = "\"'`") -> str:
    """The source with the contents of strings and comments blanked out; lengths and line ends stay."""
    pattern = r"//[^\n]*|/\*.*?\*/" + (r"|#[^\n]*" if hash_comments else "")
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\\n])*{q}" if q != "`" else r"`(?:\\.|[^`\\])*`" for q in raw_quotes)
    return re.sub(f"{pattern}|{strings}", lambda m: re.sub(r"[^\n]", " ", m.group()), source, flags=re.S)


def _close(code: str, at: int) -> int:
    """Offset behind the brace that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return at + m.end()
    return len(code)


def _doc_above(lines: list[str], row: int, marks: tuple[str, ...]) -> str | None:
    """The comment that ends directly above a line."""
    i = row - 1
    while i >= 0 and lines[i].strip().startswith(("@", "#[")):
        i -= 1
    if i < 0:
        return None
    if lines[i].strip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(x.strip() for x in lines[max(j, 0) : i + 1]) if j >= 0 and lines[j].strip().startswith("/**") else None
    j = i
    while j >= 0 and lines[j].strip().startswith(marks):
        j -= 1
    return "\n".join(x.strip() for x in lines[j + 1 : i + 1]) or None


def _braced(source: str, rules: list[tuple[str, str]], owners: tuple[str, ...], marks: tuple[str, ...], method: str | None, quotes: str) -> list[Found]:
    """Declarations of a brace language: ``rules`` are (kind, pattern with the group ``n``); those inside an owner's braces that match
    ``method`` are its methods."""
    code, lines = _blank(source, raw_quotes=quotes), source.split("\n")
    out: list[Found] = []
    spans: list[tuple[int, int, str]] = []

    def add(kind: str, name: str, start: int, head_end: int, doc_row: int | None = None) -> int:
        brace = re.compile(r"[{;\n]").search(code, head_end)
        stop = head_end
        j = head_end
        while brace and brace.group() == "\n" and not re.match(r"\s*\{", code[brace.end() : brace.end() + 200]) and code.count("(", start, brace.start()) > code.count(")", start, brace.start()):
            j = brace.end()
            brace = re.compile(r"[{;\n]").search(code, j)
        if brace and (brace.group() == "{" or re.match(r"\s*\{", code[brace.end() : brace.end() + 200])):
            open_at = code.find("{", brace.start())
            stop = _close(code, open_at)
            sig = source[start:open_at].strip()
        else:
            stop = brace.start() if brace else len(code)
            sig = source[start:stop].strip()
        a, b = code.count("\n", 0, start), code.count("\n", 0, max(start, stop - 1))
        out.append(Found(kind, name, a + 1, b + 1, sig, _doc_above(lines, a if doc_row is None else doc_row, marks), source[start:stop]))
        return stop

    taken: list[tuple[int, int]] = []
    for kind, pattern in rules:
        for m in re.finditer(pattern, code, re.M):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if any(a < start < b for a, b in taken):
                continue
            name = m.group("n")
            stop = add(kind, name, start, m.end())
            if kind in owners:
                spans.append((m.end(), stop, name.removeprefix("impl::").split(" for ")[-1].split("<")[0]))
            elif kind in ("function", "async_function"):
                taken.append((start, stop))
    if method:
        for a, b, owner in spans:
            inner, depth_start = code[a:b], code.find("{", a - 1, b)
            for m in re.finditer(method, inner, re.M):
                at = a + m.start() + len(m.group()) - len(m.group().lstrip())
                if depth_start < 0 or code.count("{", depth_start, at) - code.count("}", depth_start, at) != 1:
                    continue
                head = m.group()
                add(("async_method" if re.search(r"\basync\b", head) else "method") if not head.lstrip().startswith(("fn", "pub fn", "pub async fn")) else "function", f"{owner}::{m.group('n')}", at, a + m.end())
    return out


_JS_WORDS = r"(?!(?:if|for|while|switch|catch|return|function|else|do|new|await|typeof)\b)"


def script(source: str) -> list[Found]:
    """TypeScript and JavaScript."""
    mod = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
    rules = [
        ("import", r"^\s*import\s[^;\n]*?(?P<n>[\w$*{},\s]*)"),
        ("class", rf"^[ \t]*{mod}(?:abstract\s+)?class\s+(?P<n>[\w$]+)"),
        ("interface", rf"^[ \t]*{mod}interface\s+(?P<n>[\w$]+)"),
        ("enum", rf"^[ \t]*{mod}(?:const\s+)?enum\s+(?P<n>[\w$]+)"),
        ("type_alias", rf"^[ \t]*{mod}type\s+(?P<n>[\w$]+)[^=\n]*="),
        ("async_function", rf"^[ \t]*{mod}async\s+function\s*\*?\s*(?P<n>[\w$]+)"),
        ("function", rf"^[ \t]*{mod}function\s*\*?\s*(?P<n>[\w$]+)"),
        ("async_function", rf"^[ \t]*{mod}(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*async\s*(?:\([^)]*\)|[\w$]+)[^=\n]*=>"),
        ("function", rf"^[ \t]*{mod}(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:\([^)]*\)|[\w$]+)[^=\n]*=>"),
    ]
    found = _braced(source, rules, ("class",), ("///",), rf"^[ \t]*(?:(?:public|private|protected|static|readonly|async|get|set|override)\s+)*{_JS_WORDS}(?P<n>[\w$#]+)\s*(?:<[^>]*>)?\([^;{{]*\)[^;{{=]*\{{", "\"'`")
    for f in found:
        if f.kind == "import":
            f.name = f.signature = f.body = f.body.strip().rstrip(";")
    return found


def rust(source: str) -> list[Found]:
    vis = r"(?:pub(?:\([^)]*\))?\s+)?"
    rules = [
        ("import", rf"^\s*{vis}use\s+(?P<n>[^;]+)"),
        ("module", rf"^\s*{vis}mod\s+(?P<n>\w+)"),
        ("struct", rf"^\s*{vis}struct\s+(?P<n>\w+)"),
        ("enum", rf"^\s*{vis}enum\s+(?P<n>\w+)"),
        ("trait", rf"^\s*{vis}(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
        ("macro", r"^\s*macro_rules!\s*(?P<n>\w+)"),
        ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?P<n>[\w:<>, ]+?(?:\s+for\s+[\w:<>, ]+?)?)\s*(?=\{|where)"),
        ("function", rf"^{vis}(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<n>\w+)"),
    ]
    found = _braced(source, rules, ("impl", "trait"), ("///",), rf"^[ \t]*{vis}(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<n>\w+)", '"')
    for f in found:
        if f.kind == "impl":
            f.name = f"impl::{f.name.strip()}"
        elif f.kind == "module":
            f.name = f"mod::{f.name}"
        elif f.kind in ("method", "async_method"):
            f.kind = "function"
    return found


def swift(source: str) -> list[Found]:
    mod = r"(?:(?:public|private|internal|open|fileprivate|final|static|class|override|mutating|@\w+)\s+)*"
    rules = [
        ("import", r"^\s*import\s+(?P<n>[\w.]+)"),
        ("class", rf"^\s*{mod}(?:class|actor)\s+(?!func\b)(?P<n>\w+)"),
        ("struct", rf"^\s*{mod}struct\s+(?P<n>\w+)"),
        ("enum", rf"^\s*{mod}(?:indirect\s+)?enum\s+(?P<n>\w+)"),
        ("interface", rf"^\s*{mod}protocol\s+(?P<n>\w+)"),
        ("extension", rf"^\s*{mod}extension\s+(?P<n>[\w.]+)"),
        ("function", rf"^{mod}func\s+(?P<n>\w+)"),
    ]
    found = _braced(source, rules, ("class", "struct", "enum", "interface", "extension"), ("///",), rf"^[ \t]*{mod}(?:func\s+)?(?<![\w.])(?P<n>(?<=func )\w+|init|deinit)\b", '"')
    for f in found:
        if f.kind in ("function", "method") and re.search(r"\)\s*async\b", f.signature):
            f.kind = f"async_{f.kind}"
    return [f for f in found if f.kind != "extension"]


def shell(source: str) -> list[Found]:
    lines, code = source.split("\n"), _blank(source, hash_comments=True)
    out = []
    for m in re.finditer(r"^(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{|^function\s+(?P<n2>[\w-]+)\s*\{", code, re.M):
        name = m.group("n") or m.group("n2")
        stop = _close(code, code.find("{", m.start()))
        a, b = code.count("\n", 0, m.start()), code.count("\n", 0, max(0, stop - 1))
        j = a - 1
        while j >= 0 and lines[j].startswith("#") and not lines[j].startswith("#!"):
            j -= 1
        out.append(Found("function", name, a + 1, b + 1, f"{name}()", "\n".join(lines[j + 1 : a]) or None, source[m.start() : stop]))
    return out


def html(source: str) -> list[Found]:
    out = []
    for m in re.finditer(r"<(script|style)\b[^>]*>.*?</\1\s*>", source, re.S | re.I):
        tag = m.group(1).lower()
        row = source.count("\n", 0, m.start()) + 1
        out.append(Found(f"{tag}_block", f"{tag}@{row}", row, row + m.group().count("\n"), f"<{tag}>", None, m.group()))
    return out


_SQL = re.compile(r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|UNIQUE\s+|MATERIALIZED\s+)*(TABLE|VIEW|FUNCTION|INDEX|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)", re.I | re.M)
_SQL_KIND = {"table": "struct", "view": "type_alias", "function": "function", "index": "constant", "type": "enum"}


def sql(source: str) -> list[Found]:
    out = []
    for m in _SQL.finditer(source):
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        dollar = re.compile(r"\$(\w*)\$").search(source, m.end())
        semi = source.find(";", m.end())
        if dollar and (semi < 0 or dollar.start() < semi):
            end = source.find(dollar.group(), dollar.end())
            semi = source.find(";", end if end > 0 else dollar.end())
        stop = semi + 1 if semi >= 0 else len(source)
        name = m.group(2).split(".")[-1].strip('"`')
        row = source.count("\n", 0, start) + 1
        body = source[start:stop]
        out.append(Found(_SQL_KIND[m.group(1).lower()], name, row, row + body.count("\n"), body.split("\n")[0].strip(), None, body))
    return out


def markdown(source: str) -> list[Found]:
    """Headings with their sections; a heading's section holds those of deeper headings."""
    lines = source.split("\n")
    heads: list[tuple[int, int, str]] = []
    fenced = False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        m = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if m:
            heads.append((i, len(m.group(1)), m.group(2)))
        elif i and re.match(r"(=+|-+)\s*$", line) and lines[i - 1].strip() and not lines[i - 1].lstrip().startswith(("#", "-", "|", ">")):
            heads.append((i - 1, 1 if line[0] == "=" else 2, lines[i - 1].strip()))
    out = []
    for k, (row, level, title) in enumerate(heads):
        end = next((r for r, lv, _ in heads[k + 1 :] if lv <= level), len(lines))
        while end > row + 1 and not lines[end - 1].strip():
            end -= 1
        out.append(Found("module", title, row + 1, end, f"{'#' * level} {title}", None, "\n".join(lines[row:end])))
    return out


EXTRACTORS = {"python": python, "typescript": script, "tsx": script, "javascript": script, "jsx": script, "rust": rust, "swift": swift, "shell": shell, "html": html, "sql": sql, "markdown": markdown}


def symbols_of(path: str, content: str | None, language: str | None = None) -> list[Found]:
    """The symbols of one file; unknown languages and null contents give none."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    f = EXTRACTORS.get(language or EXTENSIONS.get(ext, ""))
    return f(content) if f and content else []


SYMBOLS = "file_path string, name string, leaf_name string, kind string, start_line int, end_line int, signature string, docstring string, body string, language string"


def extract(files: DataFrame) -> DataFrame:
    """A symbol table from ``files`` (``path``, ``content``, optionally ``language``, ``is_stub``): ids, names, hashes included."""
    lang = F.col("language") if "language" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, language in zip(pdf["path"], pdf["content"], pdf["language"]):
                ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                lg = language or EXTENSIONS.get(ext)
                for s in symbols_of(path, content, lg):
                    rows.append((path, s.name, s.name.split("::")[-1], s.kind, s.start, s.end, s.signature, s.docstring, s.body, lg))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    out = files.where("path IS NOT NULL").select("path", "content", lang.alias("language")).mapInPandas(run, SYMBOLS)
    return out.withColumns({"id": F.xxhash64("file_path", "name", "start_line"), "fqn": F.concat_ws("::", "file_path", "name"), "content_hash": F.sha2("body", 256), "is_stub": F.col("file_path").rlike(r"\.(pyi|d\.ts|swiftinterface)$")})


#: Names that a tree walk leaves out.
SKIPPED = ("node_modules", "target", "__pycache__", ".git", "dist", "build", ".build")


def scan(spark, root: str) -> DataFrame:
    """``path`` (below ``root``), ``content``, ``content_hash`` of the source files of a tree, as its ignore files have it, without
    package and build folders; files whose name or content looks secret (S3, S4) are left out."""
    from codeweft.functions.text import holds_key, sensitive_name

    rows = walk.read(spark, root, walk.list_files(root, walk.INDEXED, skip=SKIPPED))
    return rows.where(~sensitive_name(F.col("path")) & ~holds_key(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def scan_stubs(spark, root: str) -> DataFrame:
    """Type stubs of installed packages, marked as such and never skipped."""
    rows = walk.read(spark, root, walk.stub_files(root))
    return rows.withColumns({"content_hash": F.sha2("content", 256), "is_stub": F.lit(True)})
