"""Work lists, best repeats, latest runs and checks on the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even


def work_list(cases: DataFrame, models: DataFrame, repeats: int = 3, creative_seeds=(41, 42, 43), seed: int = 42) -> DataFrame:
    """Every case with every model and repeat, with the repeat's seed."""
    seeds = F.when(F.col("category") == "creative", F.array(*map(F.lit, creative_seeds))).otherwise(F.array(*[F.lit(seed)] * repeats))
    all_pairs = cases.crossJoin(models)  # the work list is that product
    return all_pairs.select("*", F.posexplode(F.slice(seeds, 1, repeats)).alias("repeat", "seed")).withColumn("repeat", F.col("repeat") + 1)


def declared(cases: DataFrame) -> DataFrame:
    """Cases with the defaults of sampling filled in."""
    return cases.withColumns(
        {
            "temperature": F.coalesce("temperature", F.lit(0.0)),
            "max_tokens": F.coalesce("max_tokens", F.lit(512)),
            "top_p": F.when(F.col("category") == "creative", 0.95).otherwise(1.0),
        }
    )


def missing_models(required: DataFrame, served: DataFrame) -> DataFrame:
    """Required models that the server doesn't list; a run needs this to be empty."""
    return required.join(served.select("served_model"), "served_model", "left_anti")


def best_repeat(runs: DataFrame, keys: list[str], score: str = "score", order: str | list[str] = "seq") -> DataFrame:
    """The run with the highest score for each key; the first of equals, and the first of all where none is scored."""
    rest = [F.col(c).asc_nulls_first() for c in ([order] if isinstance(order, str) else order)]
    ranked = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), *rest)
    return runs.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def latest_run(files: DataFrame, model: str = "model", run: str = "run_ts", entries: DataFrame | None = None) -> DataFrame:
    """Files of each model's last run by name. entries: all runs (model, run_ts); a last run without files then has no rows, and no earlier one stands in for it."""
    last = (files if entries is None else entries).groupBy(model).agg(F.max(run).alias("__last"))
    return files.join(last, model).where(F.col(run) == F.col("__last")).drop("__last")


def needs_judge(score_type: Column) -> Column:
    return score_type.isNull() | (score_type == "needs_judge")


def opening_is_empty(runs: DataFrame, keys: list[str], empty: Column, order: str, first: int = 3) -> DataFrame:
    """For each key whether its first runs, that many at least, are all empty: the sign of a broken setup."""
    ranked = runs.withColumn("__empty", empty).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__n") <= first)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_opening"), ((F.count("*") == first) & F.min("__empty")).alias("abort"))


def session(runs: DataFrame, bench_run_id: Column | str, column: str = "bench_run_id") -> DataFrame:
    """Runs of one session; models are compared inside a session."""
    return runs.where(F.col(column) == bench_run_id)


def scored_only(runs: DataFrame, repeat: str = "repeat") -> DataFrame:
    """Without warm-up calls, whose repeat isn't positive."""
    return runs.where(F.col(repeat) > 0)


def registered(runs: DataFrame, registry: DataFrame, label: str = "model_label") -> DataFrame:
    """Runs with what the registry says of their model. A run of an unknown model is an error."""
    joined = runs.join(registry.withColumn("__known", F.lit(True)), label, "left")
    said = F.concat(F.lit("unknown model "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    return joined.where(F.when(F.col("__known"), True).otherwise(F.raise_error(said).cast("boolean"))).drop("__known")


def real_throughput(transcripts: DataFrame, runs: DataFrame) -> DataFrame:
    """Tokens a second of each model by what was really written, reasoning too: a quarter of the characters of the transcript over the run's gen_s, as a mean over runs and of all runs together.

    transcripts (bench_run_id, run_id, response, reasoning) and runs (bench_run_id, run_id, model_label, gen_s) meet by
    both ids; runs that took no time are left out.
    """
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    written = transcripts.select("bench_run_id", "run_id", ((size("response") + size("reasoning")) / 4.0).alias("tokens"))
    joined = runs.where("gen_s > 0").select("bench_run_id", "run_id", "model_label", "gen_s").join(written, ["bench_run_id", "run_id"])
    out = joined.groupBy("model_label").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("tokens") / F.col("gen_s")), 6).alias("mean_of_ratios"), F.bround(F.sum("tokens") / F.sum("gen_s"), 6).alias("ratio_of_sums"))
    return out


def run_table(transcripts: DataFrame, cases: DataFrame, registry: DataFrame) -> DataFrame:
    """The run log (schemas.RUN) that transcripts come to, so that one sink is enough. cases and registry give what a transcript doesn't repeat.

    Transcripts carry repeat and seed; seconds are rounded to 4 places, tokens a second to 2.
    """
    m = lambda c, n: half_even(F.coalesce(F.col(f"metrics.{c}"), F.lit(0.0)), n).alias(c)
    asked = declared(cases).select(F.col("id").alias("prompt_id"), "temperature", "top_p", "max_tokens")
    joined = registered(transcripts, registry.withColumnRenamed("label", "model_label")).join(asked, "prompt_id", "left")
    return joined.select(
        "bench_run_id", "run_id", "model_label", "served_model", "quant", "category", "prompt_id", "repeat", "seed", "temperature", "top_p", "max_tokens",
        m("ttft_s", 4), m("gen_s", 4), m("total_s", 4), F.coalesce("metrics.output_tokens_approx", F.lit(0)).alias("output_tokens_approx"), m("tok_per_s", 2),
        "finish_reason", (F.col("score_type") != "invalid").alias("valid"), F.col("score_raw").cast("string").alias("score_raw"), "score_type",
    )


def keyed(runs: DataFrame, session: str) -> DataFrame:
    """Runs at ingest: bench_run_id of the session and a run_id of 8 characters each. Drawn anew whenever the plan runs, so write the result before anything reads it twice."""
    return runs.withColumns({"bench_run_id": F.lit(session), "run_id": F.left(F.uuid(), F.lit(8))})


def run_stamp(c: Column) -> Column:
    """A time as the name of a run's folder."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def progress(cases: DataFrame, best: DataFrame, judged: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Counters of a judging run: prompts, those with an answer, those judged, those skipped."""
    answered, done = best.select(prompt).distinct().withColumn("__a", F.lit(1)), judged.select(prompt).distinct().withColumn("__j", F.lit(1))
    joined = cases.select(prompt).distinct().join(answered, prompt, "left").join(done, prompt, "left")
    return joined.agg(F.count("*").alias("prompts"), F.count("__a").alias("answered"), F.count("__j").alias("judged"), (F.count("*") - F.count("__j")).alias("skipped"))


def shortened(c: Column, first: int | None = None, last: int | None = None) -> Column:
    """The first or the last so many characters of a text."""
    return F.left(c, F.lit(first)) if first is not None else F.right(c, F.lit(last))
