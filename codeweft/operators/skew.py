"""Per-key results when a few keys hold most rows (problem 5).

Two-stage salted aggregation. Heavy keys are found from pre-aggregated counts over all rows; a key is heavy from
``heavy_share`` of the rows on, so there are at most ``1 / heavy_share`` of them and that list may be broadcast. Rows of
heavy keys get a salt, partial results are computed per (key, salt) and merged by key.

For distinct counts the salt is a hash of the counted value, so each value of a key falls under one salt only and the
partial distinct counts simply add up; it is also the same in a re-run task, unlike a random salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 1024
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Keys with at least ``heavy_share`` of the rows: ``keys``. At most ``1/heavy_share`` rows.

    Both aggregations combine on the map side, so a hot key sends one row per task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("__n") >= F.col("__total") * F.lit(heavy_share)).select(*keys)


def salted(df: DataFrame, keys: list[str], by: str, salts: int = SALTS, heavy_share: float = HEAVY_SHARE, name: str = "__salt") -> DataFrame:
    """``df`` with a salt column: ``hash(by) mod salts`` for rows of heavy keys, 0 for all others. Keeps every row."""
    hot = heavy_keys(df.select(*keys), keys, heavy_share).select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__hot_{i}"))
    joined = df.join(F.broadcast(hot), cond, "left").select(*df.columns, "__hot")
    return joined.withColumn(name, F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot")


def salted_distinct_count(df: DataFrame, keys: list[str], value: str, salts: int = SALTS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``keys``, ``n_rows`` and ``n_distinct`` (distinct non-null ``value``) per key, without a hot task.

    Null keys form groups of their own. An empty input gives an empty result. Repeated rows count in ``n_rows`` only.
    Columns besides ``keys`` and ``value`` are ignored, whatever their names.
    """
    narrow = df.select(*keys, F.col(value).alias("__v"))
    # stage 1: one row per (key, salt, value), already combined in each task before the shuffle
    once = salted(narrow, keys, "__v", salts, heavy_share).groupBy(*keys, "__salt", "__v").agg(F.count(F.lit(1)).alias("__r"))
    partial = once.groupBy(*keys, "__salt").agg(F.sum("__r").alias("__rows"), F.count("__v").alias("__d"))
    # stage 2: at most `salts` rows per heavy key
    return partial.groupBy(*keys).agg(F.sum("__rows").alias("n_rows"), F.sum("__d").alias("n_distinct"))


def salted_sum(df: DataFrame, keys: list[str], value: str, by: str, salts: int = SALTS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``keys``, ``n_rows``, ``total``, ``least``, ``most`` of ``value`` per key by the same two stages."""
    narrow = df.select(*keys, F.col(value).alias("__v"), F.col(by).alias("__by"))
    partial = salted(narrow, keys, "__by", salts, heavy_share).groupBy(*keys, "__salt").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__v").alias("__s"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    return partial.groupBy(*keys).agg(F.sum("__rows").alias("n_rows"), F.sum("__s").alias("total"), F.min("__lo").alias("least"), F.max("__hi").alias("most"))


def dominant_keys(df: DataFrame, keys: list[str], value: str, share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of all distinct (value, key) rows: ``keys``, ``n_distinct``, ``share``."""
    per_key = salted_distinct_count(df, keys, value)
    total = per_key.agg(F.sum("n_distinct").alias("__all"))
    return per_key.crossJoin(F.broadcast(total)).where(F.col("n_distinct") >= F.lit(share) * F.col("__all")).select(
        *keys, "n_distinct", (F.col("n_distinct") / F.col("__all")).alias("share")
    )
