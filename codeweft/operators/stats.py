"""Usage statistics and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import CALLABLE, TYPE_DEFS

USD_PER_MILLION = 3.0


def since(log: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """A1: rows of the last ``days`` days, the bound included, and later ones."""
    return log.where(F.col("timestamp") >= F.lit(now - dt.timedelta(days=days)))


def usage(log: DataFrame, usd_per_million: float = USD_PER_MILLION) -> DataFrame:
    """A2: one row: number of queries, tokens, tokens of the candidate files, saved tokens and share, cost saved."""
    g = log.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("candidate_file_tokens"), F.lit(0)).alias("candidate_tokens"))
    saved = F.greatest(F.col("candidate_tokens") - F.col("tokens"), F.lit(0))
    return g.withColumn("saved", saved).withColumn("saved_pct", F.when(F.col("candidate_tokens") > 0, F.round(100.0 * F.col("saved") / F.col("candidate_tokens"), 4)).otherwise(0.0)).withColumn("usd_saved", F.round(F.col("saved") * usd_per_million / 1e6, 6))


def latency(log: DataFrame) -> DataFrame:
    """A3: ``median`` and ``p95``: the values at positions n div 2 and 95 n div 100 of the sorted latencies.

    Taken from the histogram of latencies (milliseconds, so it is small whatever the log), not from a sorted list.
    """
    from pyspark.sql import Window

    hist = log.where("latency_ms IS NOT NULL").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("c"))
    cum = hist.withColumn("upto", F.sum("c").over(Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(hist.agg(F.sum("c").alias("n"))))
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col("latency_ms")))
    return cum.agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 95 / 100)).alias("p95"))


def shares(log: DataFrame, column: str) -> DataFrame:
    """A4: value, count and percentage of a column, nulls as ``unknown``."""
    g = log.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("__t")))).select(column, "n", F.round(100.0 * F.col("n") / F.col("__t"), 4).alias("pct"))


def languages(log: DataFrame) -> DataFrame:
    """A5: how many queries hit each language; blanks are left out."""
    return log.select(F.explode("languages_hit").alias("language")).select(F.trim("language").alias("language")).where("language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def workspace_savings(log: DataFrame, symbols: DataFrame) -> DataFrame:
    """Average tokens per query against the whole workspace (characters / 4)."""
    q = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("t"))
    w = symbols.agg(F.coalesce(F.sum(F.floor(F.length("body") / 4)), F.lit(0)).cast("long").alias("workspace_tokens"))
    avg = F.when(F.col("n") > 0, F.floor(F.col("t") / F.col("n"))).otherwise(0).cast("long")
    return q.crossJoin(F.broadcast(w)).select(avg.alias("avg_tokens"), "workspace_tokens", F.when(F.col("workspace_tokens") > 0, F.round(100.0 * F.greatest(F.col("workspace_tokens") - avg, F.lit(0)) / F.col("workspace_tokens"), 4)).otherwise(0.0).alias("saved_pct"))


def candidate_tokens(symbols: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per query the tokens of all symbols in its pivots' files, and the sorted extensions of these files."""
    files = pivots.select("query_id", "file_path").distinct()
    per_file = symbols.groupBy("file_path").agg(F.sum(F.floor(F.octet_length("body") / 4)).cast("long").alias("t"))
    both = files.join(per_file, "file_path")
    ext = F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)
    return both.groupBy("query_id").agg(F.sum("t").alias("candidate_file_tokens"), F.array_sort(F.collect_set(ext)).alias("languages_hit"))


def module_docs(symbols: DataFrame, least: int = 3) -> DataFrame:
    """Per directory with at least three non-import symbols: their number, and the types and functions by name with the
    first line of their documentation, as text. A directory of any size is one row of text; its parts are sorted arrays."""
    d = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit("."))
    doc = F.trim(F.substring_index(F.coalesce("docstring", F.lit("")), "\n", 1))
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.when(doc != "", F.concat(F.lit(": "), doc)).otherwise(F.lit("")))
    rows = symbols.where(F.col("kind") != "import").select(d.alias("dir"), "kind", F.struct(F.coalesce("name", F.lit("")).alias("n"), line.alias("l")).alias("s"))
    pick = lambda kinds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.col("s")))), lambda x: x["l"]), "\n")
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n_symbols"), pick(TYPE_DEFS).alias("types"), pick(CALLABLE).alias("functions")).where(F.col("n_symbols") >= least)


def index_status(symbols: DataFrame, link: DataFrame, files: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of counts."""
    s = symbols.agg(F.count(F.lit(1)).alias("n_symbols"), F.coalesce(F.sum(F.col("is_stub").cast("long")), F.lit(0)).alias("n_stubs"), F.coalesce(F.sum(F.floor(F.length("body") / 4)), F.lit(0)).cast("long").alias("workspace_tokens"))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return s.crossJoin(one(link, "n_edges")).crossJoin(one(files, "n_files")).crossJoin(one(obs, "n_observations"))
