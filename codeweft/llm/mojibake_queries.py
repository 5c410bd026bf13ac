"""Queries of the encoding repair (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import mojibake
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text that was read with a wrong encoding."""
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


@LLM.add("p9_restored")
def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with the text as far as it could be regained, and the moves."""
    return mojibake.repair_column(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Rightly decoded text of the Western kind, by its characters.
_PLAIN = "[^\\x00-\\x7FäöüÄÖÜßéèêàâçñãõáíóúâôîûÉÀÇ–—“”’„…]"
_CLEAN = f"regexp_matches(text, '[äöüßéèêàçñãõáíóú]') AND NOT regexp_matches(text, '{_PLAIN}') AND NOT regexp_matches(text, 'Ã|â€|&#|&[A-Za-z]+;|%[0-9A-F][0-9A-F]|\\\\[ux]')"


@LLM.add("p9_round_trip", f"SELECT count(*) AS n_texts, true AS reached FROM documents WHERE {_CLEAN}")
def p9_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of Western characters, read as Latin-1 on purpose and restored: how many there are, and whether 0.98 of
    them come back as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = docs.where(F.col("text").rlike("[äöüßéèêàçñãõáíóú]") & ~F.col("text").rlike(_PLAIN) & ~F.col("text").rlike("Ã|â€|&#|&[A-Za-z]+;|%[0-9A-F][0-9A-F]|\\\\[ux]"))
    wrong = plain.withColumn("text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    back = mojibake.repair_column(wrong, "doc_id", "text", mojibake.learn_pairs(docs, "text")).select("doc_id", "restored")
    both = plain.join(back, "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_texts"), (F.count(F.when(F.col("restored") == F.col("text"), 1)) >= 0.98 * F.count(F.lit(1))).alias("reached"))
