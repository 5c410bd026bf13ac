"""Reading the engine's tables from a folder of Parquet tables, with the normal forms of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stored and display spellings of symbol kinds (fixed values), display -> stored.
KIND_SPELLINGS = {
    "fn": "function",
    "async fn": "async_function",
    "type": "type_alias",
    "mod": "module",
    "const": "constant",
    "var": "variable",
    "async method": "async_method",
    "script": "script_block",
    "style": "style_block",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_kind(kind: Column) -> Column:
    """Stored spelling of a symbol kind: trimmed, lower case, display spellings translated. Null stays null."""
    low = F.lower(F.trim(kind))
    out = low
    for shown, stored in KIND_SPELLINGS.items():
        out = F.when(low == shown, F.lit(stored)).otherwise(out)
    return out


def canonical_source(source: Column) -> Column:
    """Lower case, trimmed, with ``_`` for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), "[ -]+", "_")


def edge_kind(kind: Column) -> Column:
    """Trimmed, lower-case edge kind; null stays null."""
    return F.lower(F.trim(kind))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol table with exact repeats folded and kinds, languages and hashes in their normal form."""
    return clean_symbols(table(spark, sf_dir, "symbols"))


def clean_symbols(raw: DataFrame) -> DataFrame:
    return (
        raw.where(F.col("id").isNotNull())
        .dropDuplicates(["id"])
        .withColumns({"kind": canonical_kind(F.col("kind")), "language": F.lower(F.trim("language")), "content_hash": F.lower("content_hash"), "is_stub": F.coalesce("is_stub", F.lit(False))})
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``fqn``, ``name``, ``kind``, ``file_path``, ``is_stub`` of all symbols, the shared library's included."""
    cols = ["id", "fqn", "name", "kind", "file_path", "is_stub"]
    own = symbols(spark, sf_dir).select(*cols)
    lib = table(spark, sf_dir, "library_symbols").withColumn("is_stub", F.coalesce("is_stub", F.lit(False))).select(*cols)
    return own.unionByName(lib.join(own.select("id"), "id", "left_anti"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations, the last row of each id."""
    return last_row(table(spark, sf_dir, "observations"), "id", "created_at")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged queries, the last row of each id."""
    return last_row(table(spark, sf_dir, "query_log"), "id", "timestamp")


def last_row(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
