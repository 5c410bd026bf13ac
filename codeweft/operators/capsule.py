"""Packing selected symbols into a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import skeleton_tokens, tokens

BUDGET = 4000
RESERVE = 0.15
WHOLE, WINDOW = 300, 600
_WORDS = re.compile(r"[^\W_]+", re.U)


def chunk_for_query(body: str, query: str, max_tokens: int) -> str:
    """The window of lines with most occurrences of the query's words, of less than ``max_tokens`` x 4 characters; the last of equals. The
    first line stays, and marks show what is left out. A body that fits comes back whole."""
    room = max_tokens * 4
    if len(body) <= room:
        return body
    lines = body.split("\n")
    words = {w.lower() for w in _WORDS.findall(query or "") if len(w.encode()) > 2}
    best, best_score, start = (0, 1), -1, 0
    while True:
        end, size = start, 0
        while end < len(lines) and size + len(lines[end]) + 1 < room:
            size += len(lines[end]) + 1
            end += 1
        end = max(end, start + 1)
        text = "\n".join(lines[start:end]).lower()
        score = sum(text.count(w) for w in words)
        if score >= best_score:
            best, best_score = (start, end), score
        if end >= len(lines):
            break
        start += max(1, (end - start) // 2)
    a, b = best
    out = lines[a:b]
    if a > 0:
        out = [lines[0], *(["    ..."] if a > 1 else []), *out]
    if b < len(lines):
        out.append("    ...")
    return "\n".join(out)


_FLAT = {"import", "constant", "variable", "macro", "script_block", "style_block"}
_CONTAINERS = {"class", "interface", "trait", "impl", "module"}


def skeletonize(kind: str, language: str | None, signature: str | None, docstring: str | None, body: str | None) -> str:
    """The outline of a symbol: its signature and what belongs to it, without implementation."""
    sig, text = signature or "", body or ""
    doc = f"{docstring}\n" if docstring else ""
    lines = text.split("\n")
    if kind in _FLAT:
        return sig
    if kind in ("enum", "struct", "type_alias"):
        if len(lines) <= 20:
            return text
        members = [x.rstrip() for x in lines[1:] if x.strip() and x.strip() not in ("}", "};", ")")][:8]
        return "\n".join([sig, *members, "    ..."])
    if kind in ("function", "async_function", "method", "async_method"):
        return f"{doc}{sig}\n    ..." if (language or "") == "python" else f"{doc}{sig} {{ ... }}"
    if kind in _CONTAINERS:
        if len(lines) <= 5:
            return text
        return "\n".join([doc + sig, *_members(lines, language)])
    return doc + sig


def _members(lines: list[str], language: str | None) -> list[str]:
    out = []
    if (language or "") == "python":
        inner = [x for x in lines[1:] if x.strip()]
        base = min((len(x) - len(x.lstrip()) for x in inner), default=0)
        return [x.rstrip() + " ..." for x in inner if len(x) - len(x.lstrip()) == base and re.match(r"\s*(?:async\s+)?(?:def|class)\b", x)]
    depth = 0
    for x in lines:
        if depth == 1 and "(" in x and not x.strip().startswith(("//", "/*", "*")):
            out.append(x.split("{")[0].rstrip().rstrip(";") + ";")
        depth += x.count("{") - x.count("}")
    return out


PACKED = "query_id bigint, place int, id bigint, form string, tokens bigint, text string"


def pack_pivots(pivots: DataFrame, symbols: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """C1, pivots: ``query_id``, ``place``, ``id``, ``form`` (whole, window, skeleton), ``tokens``, ``text``.

    Greedy in the order of the pivots, so a fold per query over at most a handful of rows: a body above 300 tokens is cut to the window that
    fits, one that does not fit the rest is taken as its skeleton or left out. ``budget`` of the queries wins over the default. Without
    a task nothing is cut.
    """
    q = queries.select("query_id", "task", F.coalesce(F.col("budget"), F.lit(budget)).cast("int").alias("budget"))
    rows = pivots.join(symbols.select("id", "kind", "language", "signature", "docstring", "body"), "id").join(q, "query_id")
    rows = rows.withColumn("skeleton_tokens", skeleton_tokens(F.col("docstring"), F.col("signature")))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("place")
        room = int(pdf["budget"].iloc[0])
        left = room - int(room * RESERVE)
        for r in pdf.itertuples(index=False):
            body = r.body or ""
            form, text = "whole", body
            if r.task is not None and len(body.encode()) // 4 > WHOLE:
                form, text = "window", chunk_for_query(body, r.task, min(left, WINDOW))
            t = len(text.encode()) // 4
            if t > left:
                form, text, t = "skeleton", skeletonize(r.kind, r.language, r.signature, r.docstring, body), int(r.skeleton_tokens)
                if t > left:
                    continue
            left -= t
            out.append((key[0], r.place, r.id, form, t, text))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

    return rows.groupBy("query_id").applyInPandas(fold, PACKED)


def pack_adjacents(packed: DataFrame, adjacents: DataFrame, symbols: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """C1, adjacents: skeletons in order until the first that does not fit: a prefix sum."""
    used = packed.groupBy("query_id").agg(F.sum("tokens").alias("used"))
    q = queries.select("query_id", F.coalesce(F.col("budget"), F.lit(budget)).cast("int").alias("budget")).join(used, "query_id", "left")
    room = F.col("budget") - F.floor(F.col("budget") * RESERVE) - F.coalesce("used", F.lit(0))
    rows = adjacents.join(symbols.select("id", skeleton_tokens(F.col("docstring"), F.col("signature")).alias("tokens")), "id").join(q.select("query_id", room.alias("room")), "query_id")
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") <= F.col("room")).select("query_id", "place", "id", "tokens")


def pack_memories(memories: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """C1, memories: ``query_id``, ``place``, ``id``, ``content``, ``created_at``, ``symbol_fqn``, ``is_stale``, ``tokens``: in order until
    the first that does not fit the reserve: a prefix sum."""
    q = queries.select("query_id", F.floor(F.coalesce(F.col("budget"), F.lit(budget)) * RESERVE).alias("room"))
    rows = memories.withColumn("tokens", tokens(F.col("content"))).join(q, "query_id")
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") <= F.col("room")).select("query_id", "place", "id", "content", "created_at", "symbol_fqn", "is_stale", "tokens")


#: What a capsule with Swift symbols says about itself. No external tool is asked, so it is always the same.
SWIFT_HINT = "> **Swift symbols:** read from the source alone, without resolved types or expanded macros. Ask the platform's own tools where those matter."


def summary(packed: DataFrame, skeletons: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``query_id``, ``n_pivots``, ``n_skeletons``, ``total_tokens`` (the memory reserve included), ``pct`` of the budget."""
    p = packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pivots"), F.sum("tokens").alias("pt"))
    s = skeletons.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_skeletons"), F.sum("tokens").alias("st"))
    q = queries.select("query_id", F.coalesce(F.col("budget"), F.lit(budget)).cast("int").alias("budget"))
    j = q.join(p, "query_id", "left").join(s, "query_id", "left").na.fill(0, ["n_pivots", "pt", "n_skeletons", "st"])
    total = F.floor(F.col("budget") * RESERVE) + F.col("pt") + F.col("st")
    return j.select("query_id", "n_pivots", "n_skeletons", total.alias("total_tokens"), F.round(100.0 * total / F.col("budget"), 2).alias("pct"))


def render(packed: DataFrame, skeletons: DataFrame, symbols: DataFrame, queries: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``markdown``: the capsule as text, with packed ``memories`` if there are any. A query's parts are bounded
    by its budget."""
    s = symbols.select("id", "fqn", "language", "signature", "file_path")
    fence = F.concat(F.lit("### "), F.col("fqn"), F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```"))
    full = packed.join(s, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", fence.alias("t")))).alias("a"))
    brief = skeletons.join(s, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("fqn"), F.lit(": "), F.coalesce("signature", F.lit(""))).alias("t")))).alias("b"))
    j = queries.select("query_id", "task").join(full, "query_id", "left").join(brief, "query_id", "left")
    swift = packed.select("query_id", "id").unionByName(skeletons.select("query_id", "id")).join(s.where(F.col("file_path").endswith(".swift")), "id", "left_semi").select("query_id").distinct()
    j = j.join(swift.withColumn("swift", F.lit(SWIFT_HINT)), "query_id", "left")
    if memories is None:
        j = j.withColumn("c", F.lit(None).cast("array<struct<place:int,t:string>>"))
    else:
        about = F.when(F.col("symbol_fqn").isNotNull(), F.concat(F.lit(" (re: `"), F.col("symbol_fqn"), F.lit("`)"))).otherwise(F.lit(""))
        line = F.concat(F.lit("- "), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("?")), about, F.when(F.col("is_stale"), F.lit(" [stale]")).otherwise(F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
        j = j.join(memories.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("c")), "query_id", "left")
    texts = lambda c, sep: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["t"]), sep)
    return j.select("query_id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("task")), F.when(F.col("a").isNotNull(), texts("a", "\n\n")), F.when(F.col("b").isNotNull(), F.concat(F.lit("## Related\n"), texts("b", "\n"))), F.when(F.col("c").isNotNull(), F.concat(F.lit("## Memory\n"), texts("c", "\n"))), F.col("swift")).alias("markdown"))


def render_impact(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``seed``, ``markdown``: the rows of an impact query as text, with what was shown and what was cut off. A seed's rows are at
    most twice the query's ``max_results``."""
    s = symbols.select("id", "fqn", "file_path", "start_line")
    place = F.concat(F.lit("- `"), F.coalesce("fqn", F.lit("")), F.lit("` ("), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit(")"))
    lines = rows.select("seed", "relation", "place", "id", "total_affected", "truncated").join(s, "id", "left").groupBy("seed", "relation", "total_affected").agg(F.array_sort(F.collect_list(F.struct("place", place.alias("t")))).alias("a"), F.max("truncated").alias("cut"))
    more = F.col("cut") > 0
    head = F.concat(F.lit("### "), F.initcap("relation"), F.lit(" dependents ("), F.size("a").cast("string"), F.lit(" shown"), F.when(more, F.concat(F.lit(", "), F.col("cut").cast("string"), F.lit(" more truncated"))).otherwise(F.lit("")), F.lit(")"))
    tail = F.when(more, F.concat(F.lit("\n- … + "), F.col("cut").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    part = F.concat(head, F.lit("\n"), F.array_join(F.transform("a", lambda x: x["t"]), "\n"), tail)
    whole = lines.groupBy("seed", "total_affected").agg(F.array_sort(F.collect_list(F.struct("relation", part.alias("t")))).alias("p"))
    named = whole.join(s.select(F.col("id").alias("seed"), F.col("fqn").alias("target")), "seed", "left")
    title = F.concat(F.lit("## Impact graph: "), F.coalesce("target", F.col("seed").cast("string")), F.lit("\n\nTotal affected: "), F.col("total_affected").cast("string"))
    return named.select("seed", F.concat_ws("\n\n", title, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("markdown"))


def file_skeleton(symbols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``file_path``, ``id``, ``start_line``, ``text``, ``tokens``: the outlines of all symbols, optionally down to a depth."""
    rows = symbols.where("name IS NOT NULL AND kind IS NOT NULL")
    if max_depth is not None:
        rows = rows.where(F.size(F.split("name", "::")) <= max_depth)
    schema = "file_path string, id bigint, start_line int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [skeletonize(k, g, s, d, b) for k, g, s, d, b in zip(pdf["kind"], pdf["language"], pdf["signature"], pdf["docstring"], pdf["body"])]
            yield pd.DataFrame({"file_path": pdf["file_path"], "id": pdf["id"], "start_line": pdf["start_line"].astype("Int32"), "text": texts})

    out = rows.select("file_path", "id", "start_line", "kind", "language", "signature", "docstring", "body").mapInPandas(run, schema)
    return out.withColumn("tokens", tokens(F.col("text")))
