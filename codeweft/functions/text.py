"""Scalar expressions over names, paths, signatures and bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds that can be called, kinds that define types.
CALLABLE = ("function", "async_function", "method", "async_method")
TYPE_DEFS = ("class", "interface", "type_alias", "enum", "struct", "trait")
#: Words that reveal what a task is about, by intent and in order of precedence.
INTENT_WORDS = (
    ("debug", ("fix", "bug", "error", "exception", "crash", "fail", "broken")),
    ("refactor", ("refactor", "rename", "move", "restructure", "migrate", "replace")),
    ("structural", ("coordinator", "central", "manager", "architecture", "orchestrat", "hub", "entry point", "main class", "core class", "state machine", "controller")),
    ("explore", ("understand", "explain", "how does", "what is", "what does")),
    ("add", ("add", "implement", "create", "build", "new feature", "support")),
)
#: File extensions and their language.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "sh": "shell", "bash": "shell",
    "zsh": "shell", "fish": "shell", "html": "html", "htm": "html", "rs": "rust", "swift": "swift", "swiftinterface": "swift", "sql": "sql", "md": "markdown", "mdx": "markdown",
}
#: Prefixes of secret keys and the least number of token characters after them.
KEY_PREFIXES = (("AKIA", 12), ("sk-", 24), ("ghp_", 16), ("github_pat_", 8), ("glpat-", 16), ("xoxb-", 8), ("xoxp-", 8))


def intent(task: Column) -> Column:
    """The intent of a task by substrings, ``general`` if none occurs."""
    low = F.lower(task)
    out = F.lit("general")
    for name, words in reversed(INTENT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Bytes of UTF-8 / 4, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0)).cast("long")


def skeleton_tokens(docstring: Column, signature: Column) -> Column:
    """Estimate of the documentation and signature."""
    s = F.coalesce(signature, F.lit(""))
    return tokens(F.when(docstring.isNotNull(), F.concat(docstring, F.lit("\n"), s)).otherwise(s))


def leaf(name: Column) -> Column:
    """Last ``::`` segment."""
    return F.element_at(F.split(name, "::"), -1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    """anywhere in the path, any case."""
    return F.lower(path).rlike("test|spec|mock")


def is_test_file(path: Column) -> Column:
    """by the usual places and names of tests."""
    return path.rlike(r"/test|_test\.|test_|/spec|_spec\.")


def is_utility(path: Column) -> Column:
    """by the prefix of the file name."""
    return base_name(path).rlike("^(check-|run-|setup|generate|gen-|build-|deploy-)")


def trivial_exception(kind: Column, name: Column, body: Column, is_stub: Column) -> Column:
    """an exception type of at most three lines."""
    lines = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return kind.isin(*TYPE_DEFS) & name.rlike("(Error|Exception|Warning)$") & (lines <= 3) & ~is_stub


def pivot_eligible(kind: Column, name: Column, body: Column, is_stub: Column) -> Column:
    """F5."""
    return ~is_stub & (kind != "import") & ~trivial_exception(kind, name, body, is_stub)


def expand_seed(kind: Column, name: Column, is_stub: Column) -> Column:
    """exception types whose raisers are worth following."""
    return ~is_stub & kind.isin(*TYPE_DEFS) & name.rlike("(Error|Exception|Warning)$")


def query_terms(task: Column) -> Column:
    """Lower-case alphanumeric runs of at least three bytes, with repeats."""
    return F.filter(F.split(F.lower(task), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 3)


def language_of(path: Column) -> Column:
    """Language by the extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(pairs, ext)


def sensitive_name(path: Column) -> Column:
    """S3: files that should not be read, by name."""
    n = F.lower(base_name(path))
    return n.startswith(".env") | n.endswith(".env") | n.rlike("secret|credential|password") | n.rlike(r"\.(pem|key|p12|pfx)$")


def holds_key(text: Column) -> Column:
    """Whether a text holds what looks like an access key. The whole text is searched."""
    return F.coalesce(text.rlike("|".join(f"{p}[A-Za-z0-9_/-]{{{n},}}" for p, n in KEY_PREFIXES)), F.lit(False))


def cut_bytes(text: Column, n: int) -> Column:
    """X11: the longest beginning of a text that takes at most ``n`` bytes of UTF-8; no character is cut."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
    at = F.lit(max(n - 3, 0))
    for k in (n - 2, n - 1, n):
        at = F.when(~inside(k), F.lit(k)).otherwise(at) if k >= 0 else at
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(raw.substr(F.lit(1), at), "UTF-8"))


def embedding_text(kind: Column, language: Column, name: Column, signature: Column, docstring: Column, body: Column, cut: Callable[[Column, int], Column] = cut_bytes) -> Column:
    """The text of a symbol that an embedder gets; ``cut`` takes the beginning of a body, by default in bytes."""
    sig, doc, b = (F.coalesce(c, F.lit("")) for c in (signature, docstring, body))
    typed = kind.isin(*TYPE_DEFS, "impl")
    return (
        F.when(F.trim(sig) == "", name)
        .when(typed, F.concat_ws("\n", sig, F.when(doc != "", doc), cut(b, 500)))
        .when(language == "markdown", F.concat_ws("\n", sig, cut(b, 1000)))
        .otherwise(F.concat_ws("\n", sig, F.when(doc != "", doc)))
    )


def return_type(signature: Column) -> Column:
    """What stands after the last arrow of a Python signature, null if there is none."""
    out = F.trim(F.regexp_replace(F.regexp_extract(signature, r"^.* -> (.+)$", 1), r":\s*$", ""))
    return F.when(out != "", out)


def base_classes(signature: Column) -> Column:
    """Base classes of a Python class signature."""
    inner = F.regexp_extract(signature, r"^class\s+\w+\s*\(+([^()]*)\)", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
