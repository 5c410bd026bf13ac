"""Queries of the source mixture (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm import mixing
from codeweft.llm.registry import LLM
from codeweft.sources.tables import table


@LLM.add("p8_mixture")
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: token blocks by output shard and slot."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@LLM.add("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


_CHECKS = "SELECT DISTINCT regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') AS source, true AS share_met, true AS cap_kept, true AS blocks_whole FROM mix_targets WHERE source IS NOT NULL AND target_share > 0"


@LLM.add("p8_checks", _CHECKS)
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture came to, counted in it, for every listed source: whether its tokens are its share of the sources
    with a full block but for one block, no block is used more than ``max_repeats`` times, and all blocks are whole."""
    mixed, report = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    uses = mixed.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("ids")).alias("lo"), F.max(F.size("ids")).alias("hi"))
    got = uses.groupBy("source").agg(F.sum("n").alias("slots"), F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lines = report.join(got, "source", "left")
    live = F.col("available_tokens") >= mixing.BLOCK_TOKENS
    whole = Window.partitionBy()  # one row per listed source
    want = F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(whole)).otherwise(0.0) * F.sum("slots").over(whole)
    return lines.select(
        "source", (F.abs(F.coalesce("slots", F.lit(0)) - F.coalesce(want, F.lit(0.0))) <= 1).alias("share_met"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_kept"),
        F.coalesce((F.col("lo") == mixing.BLOCK_TOKENS) & (F.col("hi") == mixing.BLOCK_TOKENS), F.lit(True)).alias("blocks_whole"),
    )
