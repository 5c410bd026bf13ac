"""Queries of the tokenizer operator (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import tokens
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and its ids by the 50k byte-level vocabulary."""
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


@LLM.add(
    "p7_round_trip",
    "SELECT count(*) AS n_docs, count(*) AS n_equal, count(*) FILTER (text IS NULL OR text = '') AS n_empty FROM documents",
)
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids decode to their text again (null counts as empty): all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = tokens.decode_column(tokens.encode_column(docs, "doc_id", "was"), "doc_id", "ids")
    both = docs.join(back, "doc_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum((F.col("was") == F.col("text")).cast("long")), F.lit(0)).alias("n_equal"),
        F.coalesce(F.sum((F.col("was") == "").cast("long")), F.lit(0)).alias("n_empty"),
    )
