"""What the training-data operators share: reading, shared-folder tables and checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows of two or three numbers.
BROADCAST_ROWS = 400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew only where a plain scan has fewer partitions than the cluster has cores (a single small file).

    A plan with a shuffle is left alone: Spark sizes its partitions, and asking for their number would run it.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a session in one process gets a temporary one; a cluster has none to fall back on."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


@lru_cache(1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tallyframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that Hadoop deletes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing that is still to run reads them."""
    for t in tables:
        drop_path(t.sparkSession, t.shared_path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def doc_key(id_col: str, text_col: str):
    """A key of a row that a null or repeated id doesn't spoil. Rows alike in id and text share it, and so share every decision."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialised table of a few numbers a row for broadcast if its counted rows are within the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df
