"""Edge extraction from symbol bodies (E1-E6): tokenise, join names, drop self-links, keep each pair once.

All extractors see the whole symbol table, so an incremental run does not lose links between files that were read at
different times. The result is ``from_id``, ``to_id``, ``kind``, ``label``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import CALLABLE, TYPE_DEFS

#: Names before a parenthesis that are no calls of symbols.
NO_CALLS = (
    "if", "for", "while", "match", "fn", "let", "mut", "pub", "use", "mod", "struct", "enum", "impl", "trait", "type", "async", "await", "return", "where", "loop",
    "continue", "break", "Some", "None", "Ok", "Err", "Box", "Vec", "HashMap", "HashSet", "BTreeMap", "String", "Option", "Result", "Arc", "Mutex", "RwLock", "format",
    "println", "eprintln", "print", "eprint", "vec", "assert", "panic", "todo", "unimplemented",
)
#: Shell words that are no calls of functions.
SHELL_WORDS = (
    "if", "then", "else", "elif", "fi", "for", "in", "do", "done", "while", "until", "case", "esac", "function", "return", "local", "export", "echo", "printf", "read",
    "test", "true", "false", "exit", "break", "continue", "shift", "set", "unset", "declare", "source", "eval", "exec", "cd", "pwd", "ls", "mkdir", "rm", "cp", "mv",
    "grep", "sed", "awk", "cat", "head", "tail", "sort", "uniq", "wc", "find", "xargs", "tr", "cut", "touch", "chmod", "chown",
)
_STRINGS = r"(?s)\"\"\".*?\"\"\"|'''.*?'''"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _linked(tokens: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """``tokens`` (``from_id``, ``token``, ``label``) joined with ``names`` (``token``, ``to_id``)."""
    j = tokens.join(names, "token").where(F.col("from_id") != F.col("to_id"))
    return j.groupBy("from_id", "to_id").agg(F.min("label").alias("label")).select("from_id", "to_id", F.lit(kind).alias("kind"), "label")


def _names(symbols: DataFrame, leaf: bool = False) -> DataFrame:
    own = symbols.where("name IS NOT NULL AND kind <> 'import'").select(F.col("name").alias("token"), F.col("id").alias("to_id"))
    if not leaf:
        return own
    return own.unionByName(symbols.where("leaf_name IS NOT NULL AND kind <> 'import'").select(F.col("leaf_name").alias("token"), F.col("id").alias("to_id"))).distinct()


def import_names(language: Column, text: Column) -> Column:
    """Names that an import statement brings in."""
    t = F.regexp_replace(text, r"\s+", " ")
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^type ", ""))), lambda x: ~x.isin("", "*", "self", "type"))
    before_as = lambda a: F.transform(a, lambda x: F.regexp_replace(F.trim(x), r" as .*$", ""))
    py = F.when(t.rlike(r"^\s*from "), F.split(F.regexp_replace(F.regexp_extract(t, r" import \(?([^)#]*)", 1), r"[()]", ""), ",")).otherwise(F.split(F.regexp_extract(t, r"^\s*import ([^#]*)", 1), ","))
    braces = F.split(F.regexp_extract(t, r"\{([^}]*)\}", 1), ",")
    default = F.regexp_extract(t, r"^\s*import (?:type )?([A-Za-z_$][\w$]*)", 1)
    ts = F.concat(braces, F.array(default))
    path = F.regexp_replace(F.regexp_extract(t, r"use ([^;{]*)", 1), r" as .*$", "")
    rust = F.when(t.contains("{"), braces).otherwise(F.array(F.element_at(F.split(path, "::"), -1)))
    other = F.array(F.regexp_extract(t, r"^\s*import ([\w.]+)", 1))
    return trimmed(before_as(F.when(language == "python", py).when(language == "rust", rust).when(language.isin("typescript", "tsx", "javascript", "jsx"), ts).otherwise(other)))


def imports(symbols: DataFrame) -> DataFrame:
    """Import statements to the symbols of the imported names (full names)."""
    rows = symbols.where("kind = 'import' AND body IS NOT NULL").select(F.col("id").alias("from_id"), F.explode(F.array_distinct(import_names(F.col("language"), F.col("body")))).alias("token"))
    return _linked(rows.withColumn("label", F.col("token")), _names(symbols), "imports")


def implements(symbols: DataFrame) -> DataFrame:
    """``impl::T for U``: from U to T, without generics."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"<.*", ""))
    rows = symbols.where("kind = 'impl' AND name LIKE 'impl::% for %'").select(plain(F.regexp_extract("name", r"^impl::(.*?) for ", 1)).alias("t"), plain(F.regexp_extract("name", r" for (.*)$", 1)).alias("u")).distinct()
    n = _names(symbols).where("token NOT LIKE 'impl::%'")
    j = rows.join(n.select(F.col("token").alias("u"), F.col("to_id").alias("from_id")), "u").join(n.select(F.col("token").alias("t"), "to_id"), "t").where(F.col("from_id") != F.col("to_id"))
    return j.select("from_id", "to_id", F.lit("implements").alias("kind"), F.col("t").alias("label")).dropDuplicates(["from_id", "to_id"])


def calls(symbols: DataFrame) -> DataFrame:
    """Identifiers before a parenthesis in callables of at least 20 bytes, to full and leaf names. Strings in triple quotes are not
    searched. The label is the call up to its first closing parenthesis, 60 characters at most."""
    body = F.when(F.col("language") == "python", F.regexp_replace("body", _STRINGS, "")).otherwise(F.col("body"))
    rows = symbols.where(F.col("kind").isin(*CALLABLE) & (F.octet_length("body") >= 20)).select(F.col("id").alias("from_id"), body.alias("body"))
    pairs = F.arrays_zip(_all(F.col("body"), r"([A-Za-z0-9_]+) *\(").alias("token"), _all(F.col("body"), r"[A-Za-z0-9_]+ *(\([^()\n]{0,60}\)?)").alias("args"))
    toks = rows.select("from_id", F.posexplode(pairs).alias("pos", "x")).select("from_id", "pos", F.col("x.token").alias("token"), F.col("x.args").alias("args"))
    toks = toks.where((F.length("token") > 2) & ~F.col("token").isin(*NO_CALLS) & ~F.col("token").rlike("^[0-9]"))
    first = toks.groupBy("from_id", "token").agg(F.min_by("args", "pos").alias("args")).select("from_id", "token", F.concat("token", F.coalesce("args", F.lit("("))).alias("label"))
    return _linked(first, _names(symbols, leaf=True), "calls")


def references(symbols: DataFrame) -> DataFrame:
    """Capitalised names in the first line of callables to type definitions."""
    rows = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("body").isNotNull()).select(F.col("id").alias("from_id"), F.explode(F.array_distinct(_all(F.substring_index("body", "\n", 1), r"([A-Z][A-Za-z0-9_]+)"))).alias("token"))
    types = symbols.where(F.col("kind").isin(*TYPE_DEFS) & F.col("name").isNotNull()).select(F.col("name").alias("token"), F.col("id").alias("to_id"))
    return _linked(rows.withColumn("label", F.col("token")), types, "references")


def shell_calls(symbols: DataFrame) -> DataFrame:
    """E5: first words of the commands of shell functions to shell functions. ``$`` before a word and signs after it are cut off."""
    sh = symbols.where("language = 'shell' AND kind = 'function'")
    first = lambda x: F.element_at(F.split(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"^\$*\(*", ""), r"\s+"), 1)
    parts = F.transform(F.split("body", r"[\n;|&{(]"), lambda x: F.regexp_replace(first(x), r"[^\p{L}\p{N}_]+$", ""))
    rows = sh.where("body IS NOT NULL").select(F.col("id").alias("from_id"), F.explode(F.array_distinct(parts)).alias("token")).where(F.col("token").rlike(r"^[\p{L}_][\p{L}\p{N}_-]*$") & (F.octet_length("token") >= 2) & ~F.col("token").isin(*SHELL_WORDS))
    return _linked(rows.withColumn("label", F.col("token")), _names(sh), "calls")


def sql_references(symbols: DataFrame) -> DataFrame:
    """Names after FROM, JOIN, INTO, UPDATE in views and functions to tables and views, any case, without schema."""
    sql = symbols.where("language = 'sql'")
    toks = F.filter(F.split(F.col("body"), r"\s+"), lambda x: x != "")
    pairs = F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.when(F.lower(a).isin("from", "join", "into", "update"), b))
    clean = lambda x: F.lower(F.element_at(F.split(F.regexp_replace(x, r"[^A-Za-z0-9_.]", ""), r"\."), -1))
    rows = sql.where(F.col("kind").isin("type_alias", "function") & F.col("body").isNotNull()).select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.transform(F.filter(pairs, lambda x: x.isNotNull()), clean))).alias("token")).where("token <> ''")
    targets = sql.where("kind IN ('struct', 'type_alias') AND name IS NOT NULL").select(F.lower("name").alias("token"), F.col("id").alias("to_id"))
    return _linked(rows.withColumn("label", F.col("token")), targets, "references")


def extract(symbols: DataFrame) -> DataFrame:
    """All extractors over one symbol table, each (from, to, kind) once."""
    parts = [f(symbols) for f in (imports, implements, calls, references, shell_calls, sql_references)]
    return reduce(DataFrame.unionByName, parts).groupBy("from_id", "to_id", "kind").agg(F.min("label").alias("label"))
