"""Queries of the classifier of hand-written files (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm import handwritten
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, vendored or mere data."""
    return p1_kinds(spark, sf_dir).where("kind IS NOT NULL").select("file_path")


@LLM.add("p1_kinds")
def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kind (null: hand-written) and the margin of the decision."""
    symbols = table(spark, sf_dir, "symbols")
    model, _ = handwritten.fit_on(symbols)
    return handwritten.classify(symbols, model)


@LLM.add("p1_validation")
def p1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear cases of the held-out repositories per kind: how many there are, found, found in all, and found without leading
    comments and path."""
    model, report = handwritten.fit_on(table(spark, sf_dir, "symbols"))
    return spark.createDataFrame([(k, *v, model.masked[k]) for k, v in report.items()], "kind string, n_cases long, n_hit long, n_named long, n_hit_masked long")
