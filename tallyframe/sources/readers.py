"""Readers for suites, run logs, transcripts and harness results, and writers for what comes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from . import result_tree, schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has anything, in whatever store Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], schemas.struct(ddl))


def balanced(scan: DataFrame) -> DataFrame:
    """A plain scan that has fewer partitions than the cluster has cores, such as one small file, dealt out anew; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def suite(spark: SparkSession, path: str) -> DataFrame:
    """A prompt suite: a JSON array of cases. Expected arguments become a map from name to the JSON text of the value."""
    cases = spark.read.schema(schemas.struct(schemas.CASE)).option("multiLine", True).json(path)
    return cases.withColumn("expected_args_contain", scoring.json_fields(F.col("expected_args_contain")))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log (CSV with a header); a missing file is an empty log."""
    return spark.read.schema(schemas.struct(schemas.RUN)).option("header", True).csv(path) if exists(spark, path) else empty(spark, schemas.RUN)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts, one JSON object a line; a broken line is an error."""
    return spark.read.schema(schemas.struct(schemas.TRANSCRIPT)).option("mode", "FAILFAST").json(path)


def chunks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed lines of streamed completions, as a batch or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.struct(schemas.CHUNK)).json(path)


def raw_streams(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses of a model server, a file for each: run_id (the file's name), turn 1, seq, arrival (null), line.

    A last line that no newline ends was cut off and is left out.
    """
    files = spark.read.text(path, wholetext=True)
    whole = F.slice(F.split("value", "\n"), 1, F.greatest(F.size(F.split("value", "\n")) - 1, F.lit(0)))
    rows = files.select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("run_id"), F.posexplode(whole).alias("seq", "line"))
    return rows.select("run_id", F.lit(1).alias("turn"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast("double").alias("arrival"), "line")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded whole responses, a JSON file each: run_id (the file's name), content."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("run_id"), F.col("value").alias("content"))


def run_meta(spark: SparkSession, root: str) -> DataFrame:
    """run_meta.json of all runs under root: model, run_ts and schemas.RUN_META."""
    files = result_files(spark, root, "run_meta.json", direct=True)
    return files.select("model", "run_ts", F.from_json("content", schemas.struct(schemas.RUN_META)).alias("m")).select("model", "run_ts", "m.*")


def result_files(spark: SparkSession, root: str, file_name: str, direct: bool = False) -> DataFrame:
    """Whole files of that name anywhere under <root>/<model>/<run>/: model, run_ts, latest, inner (path below the run), content. direct: only those that lie in the run's own folder."""
    return result_tree.load(spark, root, file_name, direct)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("append").format(kind).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in place of what was there."""
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as one file, in whatever store Spark writes; for a run's metadata and output."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header, in place of what was there. Arrays must be JSON text by then."""
    df.write.mode("overwrite").option("header", True).csv(path)
