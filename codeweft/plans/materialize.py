"""Cutting lineage with tables written to the cluster's shared folder.

``spark.checkpoint.dir`` names a folder that all executors share. It is read from the session; only where it is unset
(tests, notebooks in local mode) a local folder is made. Tables written here survive the loss of an executor, unlike
cached blocks, and are compressed, unlike RDD checkpoints.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Paths and catalogue tables that this driver has written, for :func:`clear`.
_written: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one in local mode where none is set."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="codeweft-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeweft/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """Like :func:`materialize`, bucketed and sorted by ``key``: later joins on it do not move this side."""
    spark = df.sparkSession
    table = f"codeweft_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/codeweft/{table}"
    df.write.format("parquet").option("path", path).option("compression", codec).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    _written.append(path)
    _tables.append(table)
    return spark.table(table)


def if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most_rows`` rows (of a few numbers each, as its callers see to), else as it
    is: the join then shuffles, and skewed keys are split at run time. The rows are counted, so give it a written table."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def clear(spark: SparkSession) -> int:
    """Delete all tables that this driver has written to the shared folder, and take the bucketed ones out of the catalogue; results
    that still read them become unreadable. Returns how many there were."""
    n = 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
