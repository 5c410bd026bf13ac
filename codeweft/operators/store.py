"""Relational store operations as pure functions on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first_wins: bool = False) -> DataFrame:
    """``old`` and ``new`` by key; the new row replaces the old one, or with ``first_wins`` the old one stays."""
    kept, other = (old, new) if first_wins else (new, old)
    kept = kept.dropDuplicates(keys)
    return kept.unionByName(other.join(kept.select(*keys), keys, "left_anti").dropDuplicates(keys))


def to_read(scan: DataFrame, tracked: DataFrame, force: bool = False) -> DataFrame:
    """Scanned (path, content_hash) that are new or changed. Stubs are not skipped: pass them separately."""
    return scan if force else scan.join(tracked.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def gone(scan: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracked paths that are no longer there."""
    return tracked.select("path").distinct().join(scan.select("path"), "path", "left_anti")


def cascade(paths: DataFrame, symbols: DataFrame, edges: DataFrame, embeddings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without everything that belongs to the given paths."""
    dead = symbols.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    return (
        without_files(symbols, paths),
        edges_without(edges, dead),
        embeddings.join(dead.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti").select(*embeddings.columns),
        files.join(paths.select("path").distinct(), "path", "left_anti").select(*files.columns),
    )


def without_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """The symbols that are in none of the files (``path``)."""
    return symbols.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*symbols.columns)


def edges_without(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """The edges that touch none of the symbols ``dead`` (``id``)."""
    e = edges.join(dead.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return e.join(dead.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(*edges.columns)


def save(df: DataFrame, folder: str, name: str) -> None:
    """Write a table of the engine's folder. It is written beside the old one and then takes its place, so a run that fails
    leaves the old table, and a table may be replaced by what was read from it."""
    spark = df.sparkSession
    new = f"{folder.rstrip('/')}/.{name}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    path = spark._jvm.org.apache.hadoop.fs.Path
    here, there = path(new), path(f"{folder.rstrip('/')}/{name}.parquet")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(there, True)
    if not fs.rename(here, there):
        raise OSError(f"could not put {name} in its place")


def by_leaf(symbols: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """``leaf_name``, ``id``, ``place``: the first symbols (by id) of each asked leaf name."""
    w = Window.partitionBy("leaf_name").orderBy("id")
    hit = symbols.select("leaf_name", "id").join(names.select("leaf_name").distinct(), "leaf_name", "left_semi")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def resolve_pushed(pushed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pushed edges (``from_fqn``, ``to_fqn``, ``kind``) with ``from_id`` and ``to_id``, null where a name is unknown.

    ``extends`` counts as inherits, unknown kinds as references. Names stand for their first symbol."""
    ids = nodes.where("fqn IS NOT NULL").groupBy("fqn").agg(F.min("id").alias("id"))
    kind = F.lower(F.trim("kind"))
    kind = F.when(kind == "extends", "inherits").when(kind.isin("imports", "calls", "implements", "inherits", "references", "defined_in"), kind).otherwise("references")
    a = ids.select(F.col("fqn").alias("from_fqn"), F.col("id").alias("from_id"))
    b = ids.select(F.col("fqn").alias("to_fqn"), F.col("id").alias("to_id"))
    return pushed.withColumn("kind", kind).dropDuplicates(["from_fqn", "to_fqn", "kind"]).join(a, "from_fqn", "left").join(b, "to_fqn", "left")
