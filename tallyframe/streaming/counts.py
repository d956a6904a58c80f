"""Windowed counts over an event stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and the mean value for each window and type; the same for a batch and for a stream. ts may be without zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def run_to_end(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """What a stream has come to once all there is has been read, as Parquet under path: the whole result in place of the last one, or appended to it."""
    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{path}/result")
        else:
            batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")  # a batch that runs again replaces itself

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/result") if query.lastProgress else spark.createDataFrame([], stream.schema)


def own_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: in spark.checkpoint.dir, or with a single process in the machine's temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{shared or 'file://' + tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
