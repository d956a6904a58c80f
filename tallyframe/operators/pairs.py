"""Blind comparison of two models' best answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_labels(best: DataFrame, label: str = "model_label") -> DataFrame:
    """One row with the two least labels, left and right; no row where there are fewer."""
    least = best.select(F.col(label).alias("l")).distinct().orderBy("l").limit(2)
    return least.agg(F.sort_array(F.collect_list("l")).alias("ls")).where(F.size("ls") == 2).select(F.col("ls")[0].alias("left"), F.col("ls")[1].alias("right"))


def pairs(best: DataFrame, prompt: str = "prompt_id", label: str = "model_label", value: str = "score") -> DataFrame:
    """Prompts that both of the two least labels answered: prompt, model_a, model_b, a, b."""
    names = F.broadcast(two_labels(best, label))  # one row
    a = best.join(names, F.col(label) == F.col("left")).select(prompt, F.col("left").alias("model_a"), F.col(value).alias("a"))
    b = best.join(names, F.col(label) == F.col("right")).select(prompt, F.col("right").alias("model_b"), F.col(value).alias("b"))
    return a.join(b, prompt)


def missing(best: DataFrame, prompt: str = "prompt_id", label: str = "model_label") -> DataFrame:
    """Prompts that one of the two didn't answer, with which one did."""
    names = F.broadcast(two_labels(best, label))
    own = best.join(names, F.col(label).isin(F.col("left"), F.col("right")))
    seen = own.groupBy(prompt).agg(F.max(F.col(label) == F.col("left")).alias("has_a"), F.max(F.col(label) == F.col("right")).alias("has_b"))
    prompts = best.select(prompt).distinct()
    return prompts.join(seen, prompt, "left").na.fill(False, ["has_a", "has_b"]).where("not (has_a and has_b)")


def head_to_head(paired: DataFrame) -> DataFrame:
    """Wins, losses and ties of the left model over prompts that both have a score for."""
    scored = paired.where("a is not null and b is not null")
    count = lambda c: F.count_if(c)
    return scored.groupBy("model_a", "model_b").agg(
        count(F.col("a") > F.col("b")).alias("wins"), count(F.col("a") < F.col("b")).alias("losses"), count(F.col("a") == F.col("b")).alias("ties")
    )


def totals(judged: DataFrame) -> DataFrame:
    """Verdicts by winner; labels that aren't known count under their own name."""
    return judged.groupBy("winner").agg(F.count("*").alias("n"))


def means(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("n"), F.bround(F.avg("a_score"), 6).alias("mean_a"), F.bround(F.avg("b_score"), 6).alias("mean_b"))


def by_category(judged: DataFrame) -> DataFrame:
    """Verdicts by category, a column for each known winner, 0 where there is none."""
    return judged.groupBy("category").pivot("winner", ["A", "B", "tie"]).count().na.fill(0).orderBy("category")
