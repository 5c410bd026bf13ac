"""Queries of the splitting operator (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import splitting
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p6_found", "SELECT DISTINCT id FROM symbols WHERE octet_length(encode(body)) // 4 > 1000")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that come out in pieces."""
    return p6_pieces(spark, sf_dir).where("n_pieces > 1 AND piece = 0").select("id").distinct()


@LLM.add("p6_pieces")
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized bodies."""
    return splitting.split_oversized(table(spark, sf_dir, "symbols"))


_COVER = """SELECT DISTINCT id, md5(body) AS joined, octet_length(encode(body)) AS n_bytes, true AS bounded, true AS shared, true AS lined FROM symbols
    WHERE octet_length(encode(body)) // 4 > 1000"""


@LLM.add("p6_cover", _COVER)
def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of an oversized body come to: the hash and size of the text that they make without their overlaps,
    whether all are within the limit, whether each shares two lines (or 80 bytes inside a line) with the one before, and
    whether line numbers follow from the line breaks."""
    rows = table(spark, sf_dir, "symbols").select("id", "body", "start_line").distinct()
    # a row with an id that has several bodies or first lines is cut on its own
    keyed = rows.withColumn("row", F.xxhash64("id", "body", "start_line"))
    pieces = splitting.split_oversized(keyed.select(F.col("row").alias("id"), "body", "start_line"))
    shared = F.expr("substring(CAST(text AS BINARY), 1, overlap_bytes)")
    core = F.expr("substring(CAST(text AS BINARY), overlap_bytes + 1)")
    breaks = lambda c: F.length(c) - F.length(F.translate(c, "\n", ""))
    as_text = shared.cast("string")
    whole_lines = as_text.endswith("\n") & ((breaks(as_text) == splitting.OVERLAP_LINES) | (F.col("start_byte") == 0))
    told = pieces.select(
        F.col("id").alias("row"), "piece", core.alias("core"), (F.col("n_tokens") <= splitting.LIMIT_TOKENS).alias("bounded"),
        ((F.col("piece") == 0) | whole_lines | F.col("overlap_bytes").between(splitting.OVERLAP_BYTES - 3, splitting.OVERLAP_BYTES)).alias("shared"),
        (F.col("end_line") - F.col("start_line") == breaks(F.regexp_replace("text", "\n\\z", ""))).alias("lined"),
    )
    each = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "core"))).alias("p"), F.every("bounded").alias("bounded"), F.every("shared").alias("shared"), F.every("lined").alias("lined"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["core"]))
    each = each.select("row", F.md5(joined).alias("joined"), F.octet_length(joined).cast("long").alias("n_bytes"), "bounded", "shared", "lined")
    return each.join(keyed.select("row", "id"), "row").drop("row").distinct()
