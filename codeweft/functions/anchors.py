"""Names, module paths and traceback frames that a task text mentions (X1-X7), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words and common type or collection names that prose names are not taken from.
STOP_WORDS = (
    "with", "when", "where", "this", "that", "from", "into", "have", "been", "just", "like", "make", "many", "more", "most", "must", "only", "over", "such", "than",
    "then", "they", "were", "will", "upon", "what", "about", "your", "there", "their", "some", "them", "these", "those", "which", "would", "could", "should", "after",
    "before", "while", "also", "does", "other", "each", "same", "here", "because", "both", "none", "true", "false", "null", "int", "str", "dict", "list", "set", "tuple",
    "bool", "float", "bytes", "type", "kind", "name", "value", "values", "size", "length", "index", "data", "item", "items", "path", "file", "files", "line", "lines",
    "test", "tests", "error", "errors", "cause", "fail", "pass", "call", "calls", "version", "using", "result", "return", "returns", "function", "method", "class",
    "object", "module", "package", "import", "input", "output", "field", "fields", "attribute", "attributes", "example", "empty", "print", "self",
)

# The forms that count as a code block, a call, an import, a frame, an identifier and a chain.
_CODE = r"```\w*\n([\s\S]*?)```"
_CALL = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*\("
_FROM = r"(?:^|[\s:;`])from\s+([A-Za-z_][\w.]*)\s+import\s+([A-Za-z_][\w]*(?:\s*,\s*[A-Za-z_]\w*)*)"
_IMPORT = r"(?:^|[\n:;`])[ \t]*import\s+([A-Za-z_][\w.]*)"
_FRAME = r'File "([^"]+)", line \d+, in ([A-Za-z_<][\w.<>]*)'
_LINE_FRAME = r'(?m)^\s*File\s+"([^"]+)",\s*line\s+\d+,\s*in\s+([A-Za-z_<][A-Za-z0-9_<>.]*)'
_IDENT = r"([A-Za-z0-9_]{4,})"
_DOTTED = r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def code_blocks(text: Column) -> Column:
    """Contents of fenced blocks."""
    return _all(text, _CODE)


def _with_tail(names: Column) -> Column:
    """Dotted names followed by their last segment."""
    return F.flatten(F.transform(names, lambda x: F.when(x.contains("."), F.array(x, F.element_at(F.split(x, r"\."), -1))).otherwise(F.array(x))))


def calls(text: Column) -> Column:
    """Called names, dotted ones with their last segment."""
    return _with_tail(_all(text, _CALL))


def imported(text: Column) -> Column:
    """Imported names."""
    listed = F.flatten(F.transform(_all(text, _FROM, 2), lambda x: F.split(x, r"\s*,\s*")))
    return F.concat(listed, F.transform(_all(text, _IMPORT), lambda x: F.element_at(F.split(x, r"\."), -1)))


def module_paths(text: Column) -> Column:
    """Modules that are imported from or imported, distinct in order."""
    return F.array_distinct(F.concat(_all(text, _FROM, 1), _all(text, _IMPORT)))


def frames(text: Column, anywhere: bool = False) -> Column:
    """Traceback frames as structs ``path``, ``function``; synthetic and short names are left out. In the order of the text. A frame
    begins its line; ``anywhere`` takes it inside a line, too."""
    form = _FRAME if anywhere else _LINE_FRAME
    f = F.arrays_zip(_all(text, form, 1).alias("path"), _all(text, form, 2).alias("function"))
    return F.filter(f, lambda x: ~x["function"].startswith("<") & (F.octet_length(x["function"]) >= 3) & ~F.lower(x["function"]).isin(*STOP_WORDS))


def prose_names(text: Column) -> Column:
    """Identifiers with an underscore or mixed case, at least four characters, no stop words."""
    return F.filter(_all(text, _IDENT), lambda x: x.rlike("^[A-Za-z_]") & (x.contains("_") | (x.rlike("[A-Z]") & x.rlike("[a-z]"))) & ~F.lower(x).isin(*STOP_WORDS))


def dotted_names(text: Column) -> Column:
    """Dotted chains with their last segment."""
    return _with_tail(_all(text, _DOTTED))


def anchors(text: Column) -> Column:
    """Distinct names of at least three bytes, in the order: imports in code, calls in code, imports, frames, identifiers, dotted
    chains."""
    code = F.array_join(code_blocks(text), "\n")
    fn = F.transform(frames(text), lambda x: x["function"])
    names = F.concat(imported(code), calls(code), imported(text), _with_tail(fn), prose_names(text), dotted_names(text))
    return F.array_distinct(F.filter(names, lambda x: F.octet_length(x) >= 3))


def dotted(text: Column) -> Column:
    """Names that were reached through a dotted call or chain."""
    code = F.array_join(code_blocks(text), "\n")
    chains = F.concat(F.filter(_all(code, _CALL), lambda x: x.contains(".")), _all(text, _DOTTED))
    full = F.filter(F.transform(frames(text), lambda x: x["function"]), lambda x: x.contains("."))
    return F.array_distinct(F.concat(_with_tail(chains), full))
