"""Leaderboards and their relatives. Overall scores here are means over runs; collect.macro_average is the other kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def mean(c: Column | str) -> Column:
    """A mean that doesn't depend on the order of its rows: half-even to 6 places."""
    return F.bround(F.avg(c), 6)


def leaderboard(runs: DataFrame) -> DataFrame:
    """runs: model_label, valid, score. All runs, valid ones, and the mean over valid runs with a score, the best first."""
    scored = F.when(F.col("valid"), F.col("score"))
    out = runs.groupBy("model_label").agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_valid"), F.count(scored).alias("n_scored"), mean(scored).alias("mean_score"))
    return out.orderBy(F.desc("mean_score"), "model_label")


def category_scores(runs: DataFrame) -> DataFrame:
    return runs.where("score is not null").groupBy("model_label", "category").agg(F.count("*").alias("n"), mean("score").alias("mean_score"))


def category_winner(runs: DataFrame) -> DataFrame:
    """The best model of each category; of equals, to 9 places, the first by name."""
    means = runs.where("score is not null").groupBy("model_label", "category").agg(F.bround(F.avg("score"), 9).alias("mean"))
    best = Window.partitionBy("category").orderBy(F.desc("mean"), "model_label")
    return means.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("category", "model_label", F.bround("mean", 6).alias("mean_score"))


def invalid_breakdown(runs: DataFrame) -> DataFrame:
    """runs: model_label, answer, finish_reason, category. Invalid runs by their reason."""
    reason = F.when(F.col("finish_reason").eqNullSafe("error"), "error").when(F.col("answer") == "", "empty")
    reason = reason.when(F.col("finish_reason").eqNullSafe("length") & ~F.col("category").eqNullSafe("creative"), "length")
    return runs.withColumn("reason", reason).where("reason is not null").groupBy("model_label", "reason").agg(F.count("*").alias("n"))


def medians(runs: DataFrame, *columns: str) -> DataFrame:
    """Exact medians for each model, by distributed selection."""
    found = selection.medians(runs, ["model_label"], *columns)
    return found.select("model_label", *(F.bround(f"median_{c}", 6).alias(f"median_{c}") for c in columns))


def baseline_delta(summary: DataFrame, baseline: str, value: str = "mean_score") -> DataFrame:
    """Difference and ratio of each model's value to the baseline model's."""
    base = summary.where(F.col("model_label") == baseline).select(F.col(value).alias("base"))  # one row
    joined = summary.crossJoin(F.broadcast(base))
    ratio = F.when(F.col("base") != 0, F.bround(F.col(value) / F.col("base"), 6))
    return joined.select("model_label", value, F.bround(F.col(value) - F.col("base"), 6).alias("delta"), ratio.alias("ratio"))
