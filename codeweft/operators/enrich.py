"""Facts from external tools merged into the symbol table.

The tools themselves are not run here; their output comes as a table or text. Which of several suffix matches wins is
defined: the longest key, then the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import CALLABLE, base_classes, return_type


def changed_inputs(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """The gate of all enrichers: ``key``, ``hash`` rows that the cache does not hold."""
    return inputs.join(cache.select("key", "hash"), ["key", "hash"], "left_anti")


def uses_macros(body: Column) -> Column:
    """Whether Rust code invokes a macro other than the usual ones of the standard library."""
    usual = r"(?:println|print|eprintln|eprint|format|vec|assert|assert_eq|assert_ne|debug_assert|panic|todo|unimplemented|unreachable|write|writeln|matches|dbg|include_str|env|concat|stringify)"
    return body.rlike(r"(?:^|[^\w])(?!" + usual + r"!)[a-z_][a-z0-9_]*!\s*[({\[]") | body.rlike(r"#\[derive\(")


def module_path(path: Column) -> Column:
    """Module path of a Rust file below its ``src``."""
    tail = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)src/(.*)\.rs$", 1), r"(?:^|/)(?:mod|lib|main)$", "")
    return F.regexp_replace(tail, "/", "::")


def add_expanded(symbols: DataFrame, expanded: DataFrame) -> DataFrame:
    """Symbols of macro-expanded source whose names are new, marked as such."""
    new = expanded.join(symbols.select("fqn").distinct(), "fqn", "left_anti").withColumn("source", F.lit("macro_expanded"))
    return symbols.unionByName(new, allowMissingColumns=True)


def _suffix_match(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """``id``, ``resolved``: facts (``key``, ``type``) whose key is the name or a ``::``-aligned end of the fqn. An equality on the last
    segment with the end as a residual test."""
    f = facts.where("key IS NOT NULL AND type IS NOT NULL").groupBy("key").agg(F.min("type").alias("type")).withColumn("last", F.element_at(F.split("key", "::"), -1))
    s = symbols.select("id", "name", "fqn", F.element_at(F.split("name", "::"), -1).alias("last"))
    j = s.join(f, "last").withColumn("exact", F.col("key") == F.col("name")).where(F.col("exact") | F.concat(F.lit("::"), "fqn").endswith(F.concat(F.lit("::"), F.col("key"))))
    return j.groupBy("id").agg(F.min_by("type", F.struct(~F.col("exact"), -F.length("key"), "key")).alias("resolved"))


def rust_types(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Types from Rust documentation; they replace what is known, the source stays if it is set."""
    m = _suffix_match(symbols.where("language = 'rust'"), facts)
    j = symbols.join(m, "id", "left")
    return j.withColumns({"resolved_type": F.coalesce("resolved", "resolved_type"), "source": F.when(F.col("resolved").isNotNull(), F.coalesce("source", F.lit("rustdoc"))).otherwise(F.col("source"))}).drop("resolved")


def script_types(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Types from the TypeScript compiler by exact fqn, ``::``-aligned end, bare name, in this order."""
    script = symbols.where("language IN ('typescript', 'tsx', 'javascript', 'jsx')")
    exact = script.select("id", "fqn").join(facts.groupBy(F.col("fqn").alias("key")).agg(F.min("resolved_type").alias("type")), F.col("fqn") == F.col("key")).select("id", F.col("type").alias("exact_type"))
    near = _suffix_match(script, facts.select(F.col("fqn").alias("key"), F.col("resolved_type").alias("type")))
    j = symbols.join(exact, "id", "left").join(near, "id", "left")
    got = F.coalesce("exact_type", "resolved")
    return j.withColumns({"resolved_type": F.coalesce(got, "resolved_type"), "source": F.when(got.isNotNull(), F.coalesce("source", F.lit("ts"))).otherwise(F.col("source"))}).drop("resolved", "exact_type")


def python_types(symbols: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Types of Python symbols that have none: return type of the signature, else what a checker revealed at the line, else the
    base classes of a class. ``diagnostics``: ``file_path``, ``line``, ``type``."""
    d = diagnostics.groupBy("file_path", F.col("line").alias("start_line")).agg(F.min("type").alias("revealed"))
    j = symbols.join(d, ["file_path", "start_line"], "left")
    bases = base_classes(F.col("signature"))
    found = F.when(F.col("kind").isin(*CALLABLE), F.coalesce(return_type(F.col("signature")), F.col("revealed"))).when((F.col("kind") == "class") & (F.size(bases) > 0), F.array_join(bases, ", "))
    return j.withColumn("resolved_type", F.when(F.col("resolved_type").isNull() & (F.col("language") == "python"), found).otherwise(F.col("resolved_type"))).drop("revealed").select(*symbols.columns)


def parse_diagnostics(reports: DataFrame, root: str = "") -> DataFrame:
    """``file_path``, ``line`` (from 1), ``type`` of the revealed types in a checker's JSON reports (``json``)."""
    schema = "struct<generalDiagnostics: array<struct<file: string, severity: string, message: string, range: struct<start: struct<line: int>>>>>"
    rows = reports.select(F.explode(F.from_json("json", schema)["generalDiagnostics"]).alias("d")).where("d.severity = 'information'")
    path = F.regexp_replace("d.file", "^" + root.rstrip("/") + "/", "") if root else F.col("d.file")
    out = rows.select(path.alias("file_path"), (F.col("d.range.start.line") + 1).alias("line"), F.regexp_extract("d.message", r' is "(.*)"$', 1).alias("type"))
    return out.where("type <> ''")


def parse_script_facts(lines: DataFrame) -> DataFrame:
    """``fqn``, ``resolved_type``, ``line`` from lines of JSON; malformed and empty ones are left out."""
    j = lines.select(F.from_json("value", "struct<fqn: string, resolved_type: string, line: int>").alias("j"))
    return j.select("j.*").where("fqn IS NOT NULL AND fqn <> '' AND resolved_type IS NOT NULL AND resolved_type <> ''")


class Embedder(Protocol):
    """Turns texts into unit vectors of one length."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in without a model: signed hashes of words, normalised. Says nothing about meaning."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """``key``, ``embedding`` of every row with a text, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "embedding": list(embedder.embed(list(pdf["text"])))})

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def rust_type(t: object) -> str:
    """A type of the Rust documentation format as text; unknown forms give ``_``."""
    if t is None:
        return "()"
    if isinstance(t, str):
        return t
    if not isinstance(t, dict) or not t:
        return "_"
    (kind, v), *_ = t.items()
    if kind in ("primitive", "generic"):
        return v
    if kind == "resolved_path":
        args = ((v.get("args") or {}).get("angle_bracketed") or {}).get("args") or []
        inner = [rust_type(a["type"]) for a in args if isinstance(a, dict) and "type" in a]
        return (v.get("name") or v.get("path") or "_").split("::")[-1] + (f"<{', '.join(inner)}>" if inner else "")
    if kind == "borrowed_ref":
        return f"&{'mut ' if v.get('is_mutable') or v.get('mutable') else ''}{rust_type(v.get('type'))}"
    if kind == "tuple":
        return f"({', '.join(rust_type(x) for x in v)})"
    if kind == "slice":
        return f"[{rust_type(v)}]"
    if kind == "array":
        return f"[{rust_type(v.get('type'))}; {v.get('len')}]"
    if kind in ("impl_trait", "dyn_trait"):
        bounds = v if isinstance(v, list) else v.get("traits", [])
        names = [((b.get("trait_bound") or b).get("trait") or {}) for b in bounds if isinstance(b, dict)]
        return f"{'impl' if kind == 'impl_trait' else 'dyn'} {' + '.join((n.get('name') or n.get('path') or '_') for n in names)}"
    return "_"


def parse_rustdoc(reports: DataFrame) -> DataFrame:
    """``key`` (last two parts of the path), ``type``: return types of functions and sorted trait lists of types, from documents in
    the Rust documentation's JSON (``json``). Malformed documents give nothing."""
    import json

    def facts(text: str) -> Iterator[tuple[str, str]]:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return
        index, paths = doc.get("index") or {}, doc.get("paths") or {}
        traits: dict[str, set[str]] = {}
        for key, item in index.items():
            inner = item.get("inner") or {}
            path = (paths.get(str(key)) or {}).get("path") or ([item["name"]] if item.get("name") else [])
            if "function" in inner and path:
                sig = inner["function"].get("sig") or inner["function"].get("decl") or {}
                yield "::".join(path[-2:]), rust_type(sig.get("output"))
            elif "impl" in inner and (inner["impl"].get("trait") or {}):
                t = inner["impl"]["trait"]
                traits.setdefault(rust_type(inner["impl"].get("for")).split("<")[0], set()).add((t.get("name") or t.get("path") or "_").split("::")[-1])
        for name, found in traits.items():
            yield name, ", ".join(sorted(found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([f for t in pdf["json"] for f in facts(t)], columns=["key", "type"])

    return reports.select("json").mapInPandas(run, "key string, type string").distinct()
