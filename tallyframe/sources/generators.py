"""Synthetic prompts of a wanted length, and the catalogue of models and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token targets of a sweep; up to SHORT_TOKENS a fixed prompt is used.
TARGETS, SHORT_TOKENS, CHARS_PER_TOKEN = (31, 500, 2000, 8000, 16000), 50, 4
SHORT_PROMPT = "Explain step by step how a columnar query engine plans and runs an aggregation."
OPENING, CLOSING = "Read these notes on query processing:\n\n", "\n\nWhat do they say, and what follows for a slow query?"
BLOCK = "Partitioned tables are scanned in parallel and rows are combined before they move. "


def prompts(targets: DataFrame, block: str = BLOCK, short: str = SHORT_PROMPT) -> DataFrame:
    """A prompt for each row of targets (target_tokens): target_tokens, prompt. Long ones repeat a block and are cut to the target's characters."""
    t = F.col("target_tokens")
    chars = t * CHARS_PER_TOKEN
    body = F.left(F.repeat(F.lit(block), F.greatest(F.floor(chars / len(block)), F.lit(1)).cast("int")), chars)
    long = F.concat(F.lit(OPENING), body, F.lit(CLOSING))
    return targets.select("target_tokens", F.when(t <= SHORT_TOKENS, F.lit(short)).otherwise(long).alias("prompt"))


def sweep(spark: SparkSession, targets=TARGETS, block: str = BLOCK, short: str = SHORT_PROMPT) -> DataFrame:
    """prompts() for a list of targets."""
    return prompts(spark.createDataFrame([(int(x),) for x in targets], "target_tokens int"), block, short)


def listed(models: DataFrame, tasks: DataFrame) -> DataFrame:
    """What can be run: kind (model or the framework's name) and name, with the model's served name and quantisation.

    models: name, served_model, quant. tasks: framework, task; repeated rows count once.
    """
    named = models.select(F.lit("model").alias("kind"), "name", "served_model", "quant")
    none = F.lit(None).cast("string")
    return named.unionByName(tasks.distinct().select(F.col("framework").alias("kind"), F.col("task").alias("name"), none.alias("served_model"), none.alias("quant")))


def catalogue(spark: SparkSession, models: dict[str, dict], tasks: dict[str, list[str]]) -> DataFrame:
    """What can be run: kind (model or the framework's name) and name, with the model's served name and quantisation."""
    rows = [("model", k, v.get("served_model"), v.get("quant")) for k, v in models.items()]
    rows += [(f, t, None, None) for f, names in tasks.items() for t in names]
    return spark.createDataFrame(rows, "kind string, name string, served_model string, quant string").orderBy("kind", "name")
