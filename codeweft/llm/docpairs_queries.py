"""Queries of the code and documentation pairs (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm import docpairs
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods whose own documentation says something, among the pairs."""
    return docpairs.pairs(table(spark, sf_dir, "symbols")).where("origin IN ('docstring', 'body')").select("id")


@LLM.add("p3_pairs")
def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of every documented function, declarations joined with definitions."""
    return docpairs.pairs(table(spark, sf_dir, "symbols"))
