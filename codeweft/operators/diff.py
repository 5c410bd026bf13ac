"""Unified diffs against symbol lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators import capsule, memory
from codeweft.plans.materialize import materialize


def hunks(diffs: DataFrame) -> DataFrame:
    """``diff_id``, ``file_path``, ``first``, ``last``: new-side line ranges of every hunk of ``diffs`` (``diff_id``, ``diff``).

    A deleted file (``+++ /dev/null``) has no new side, so its hunks are left out. A range has at least one line.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\r?\n")).alias("n", "line"))
    head = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ ([^\t]*)", 1), "^b/", ""))
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("file_path", F.last(head, ignorenulls=True).over(w)).where(F.col("line").rlike(r"^@@ .*\+\d+"))
    first = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    size = F.regexp_extract("line", r"\+\d+,(\d+)", 1)
    n = F.when(size == "", 1).otherwise(size.cast("int"))
    return rows.where("file_path IS NOT NULL AND file_path <> '/dev/null'").select("diff_id", "file_path", first.alias("first"), (first + F.greatest(n - 1, F.lit(0))).alias("last"))


def touched(hunk: DataFrame, symbols: DataFrame) -> DataFrame:
    """F8: ``diff_id``, ``id``: symbols of the same file whose lines meet a hunk. An equality on the file with two inequalities."""
    s = symbols.where("start_line IS NOT NULL AND end_line IS NOT NULL").select("id", "file_path", "start_line", "end_line")
    j = hunk.join(s, "file_path").where((F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first")))
    return j.select("diff_id", "id").distinct()


def impact(pivots: DataFrame, link: DataFrame, symbols: DataFrame, tests: int = 5) -> DataFrame:
    """``diff_id``, ``id``, ``role`` (pivot, dependent, test): what changed, its direct callers, and up to five test symbols whose body
    names a changed symbol (found by equality on the words of the body)."""
    p = pivots.select("diff_id", "id").distinct()
    dep = p.join(link.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")), "id").select("diff_id", F.col("other").alias("id")).distinct().join(p, ["diff_id", "id"], "left_anti")
    names = p.join(symbols.select("id", "leaf_name"), "id").where("leaf_name IS NOT NULL").select("diff_id", F.col("leaf_name").alias("w")).distinct()
    t = symbols.where(F.col("file_path").rlike(r"/test|_test\.|test_|/spec|_spec\.")).select("id", F.explode(F.array_distinct(F.split(F.coalesce("body", F.lit("")), r"\W+"))).alias("w"))
    near = t.join(names, "w").select("diff_id", "id").distinct().join(p, ["diff_id", "id"], "left_anti").join(dep, ["diff_id", "id"], "left_anti")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("diff_id").orderBy("id"))).where(F.col("r") <= tests).drop("r")
    return p.withColumn("role", F.lit("pivot")).unionByName(dep.withColumn("role", F.lit("dependent"))).unionByName(near.withColumn("role", F.lit("test")))


def packed(roles: DataFrame, symbols: DataFrame, obs: DataFrame, now: dt.datetime, budget: int = capsule.BUDGET) -> DataFrame:
    """``query_id``, ``markdown`` of the roles of :func:`impact`: changed symbols whole as far as they fit, callers and tests as
    outlines, and the ten observations that mention most of the changed names."""
    q = roles.select(F.col("diff_id").alias("query_id")).distinct().withColumns({"task": F.lit(None).cast("string"), "budget": F.lit(budget)})
    s = symbols.select("id", "file_path", "start_line", "leaf_name")
    order = lambda df: df.join(s, "id").withColumn("place", F.row_number().over(Window.partitionBy("diff_id").orderBy(*[F.col(c) for c in ("role", "file_path", "start_line", "id")]))).select(F.col("diff_id").alias("query_id"), "place", "id")
    full = materialize(capsule.pack_pivots(order(roles.where("role = 'pivot'")), symbols, q, budget), "packed")
    brief = capsule.pack_adjacents(full, order(roles.where("role <> 'pivot'")), symbols, q, budget)
    names = roles.where("role = 'pivot'").join(s, "id").groupBy(F.col("diff_id").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set("leaf_name")), " ").alias("query"))
    hits = memory.search(obs, names, now, 10).join(obs.select("id", "content", "created_at", "symbol_fqn", "is_stale"), "id")
    titled = q.join(names, "query_id", "left").select("query_id", F.concat(F.lit("Changed: "), F.coalesce("query", F.lit("nothing"))).alias("task"))
    return capsule.render(full, brief, symbols, titled, capsule.pack_memories(hits, q, budget))
