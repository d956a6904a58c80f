"""Results of several harnesses as rows of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..sources import quarantine, readers

#: The columns that all collectors come to, and how a block of a judge's metric is found in free text.
COLUMNS = ("model", "framework", "task", "category", "score", "score_type", "tok_per_s")
BLOCK = r'\{[^{}]*"case_id"[^{}]*\}'


def row(model, framework, task, category, score, score_type, tok_per_s) -> list[Column]:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = ("string", "string", "string", "string", "double", "string", "double")
    return [of(v).cast(k).alias(c) for v, c, k in zip((model, framework, task, category, score, score_type, tok_per_s), COLUMNS, kinds, strict=True)]


def custom(log: DataFrame, seq: bool = False) -> DataFrame:
    """Scored rows of the own suite. score_raw is text, or a number; '0.0' is a score, '' and 'None' are none. A missing speed is 0. seq: also the row's place in the log."""
    if seq:
        log = log.withColumn("seq", F.monotonically_increasing_id())
    score = F.col("score_raw").cast("string")
    scored = log.where((F.coalesce(score, F.lit("")) != "") & (score != "None"))
    speed = F.coalesce(F.col("tok_per_s").cast("string").try_cast("double"), F.lit(0.0))
    return scored.select(*row(F.col("model_label"), "custom", F.col("prompt_id"), F.col("category"), score.cast("double"), F.coalesce("score_type", F.lit("")), speed), *(["seq"] if seq else []))


def metrics(files: DataFrame, framework: str, seq: bool = False) -> DataFrame:
    """Numeric metrics of JSON {"results": {task: {metric: value}}} ('lm-eval') or {task: {metric: value}} ('bigcode'), to 4 places.

    lm-eval metrics named alias or ending in ',none' are left out; files that don't parse are passed over. seq: also the
    task's place in its file.
    """
    parsed = files.withColumn("v", F.try_parse_json("content")).where("v is not null")
    parsed = parsed.withColumn("names", F.json_object_keys(F.get_json_object("content", "$.results") if framework == "lm-eval" else F.col("content")))
    if framework == "lm-eval":
        parsed = parsed.withColumn("v", F.try_variant_get("v", "$.results", "variant")).where("v is not null")
    flat = files.sparkSession.sql(
        """select model, array_position(names, t.key) as seq, t.key as task, m.key as metric, m.value as value from {parsed}, lateral variant_explode(v) t, lateral variant_explode(t.value) m
        where schema_of_variant(v) like 'OBJECT%' and schema_of_variant(t.value) like 'OBJECT%'""",
        parsed=parsed,
    )
    kind = F.schema_of_variant("value")
    numeric = kind.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | kind.startswith("DECIMAL")
    flat = flat.where(numeric)
    if framework == "lm-eval":
        flat = flat.where(~F.endswith("metric", F.lit(",none")) & (F.col("metric") != "alias"))
    number = F.when(kind == "BOOLEAN", F.expr("try_variant_get(value, '$', 'boolean')").cast("double")).otherwise(F.expr("try_variant_get(value, '$', 'double')"))
    kind = "accuracy" if framework == "lm-eval" else "pass@1"
    return flat.select(*row(F.col("model"), framework, F.col("task"), F.col("metric"), half_even(number, 4), kind, 0.0), *(["seq"] if seq else []))


def skipped(files: DataFrame, framework: str) -> DataFrame:
    """Files that metrics() passes over, which nobody would miss otherwise: model, run_ts, inner, reason."""
    root = F.get_json_object("content", "$.results") if framework == "lm-eval" else None
    return files.withColumn("reason", quarantine.file_reason(F.col("content"), root)).where("reason is not null").select("model", "run_ts", "inner", "reason")


def blocks(files: DataFrame, seq: bool = False) -> DataFrame:
    """Flat JSON objects with a case_id anywhere in free text; what doesn't parse, or whose score is no number, is passed over. seq: also the object's place in the text."""
    found = files.select("model", F.posexplode(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(0))).alias("seq", "block"))
    got = found.where(F.try_parse_json("block").isNotNull()).withColumn("m", F.from_json("block", "map<string, string>"))
    get = lambda k, d: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(d))
    score = F.expr("try_cast(coalesce(try_element_at(m, 'score'), '0') as double)")
    return got.where(score.isNotNull()).select(*row(F.col("model"), "deepeval", get("case_id", "unknown"), get("metric", ""), score, "judge", 0.0), *([F.col("seq").cast("long").alias("seq")] if seq else []))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def aggregate(spark: SparkSession, root: str, seq: bool = False) -> DataFrame:
    """All results under a folder: the run log runs.csv and the last runs of lm-eval, bigcode and deepeval, as rows of one shape. What isn't there adds nothing."""
    def files(framework: str, name: str, direct: bool) -> DataFrame:
        return readers.result_files(spark, f"{root}/{framework}", name, direct).where("latest")  # other runs aren't opened

    return union(
        custom(readers.runs(spark, f"{root}/runs.csv"), seq),
        metrics(files("lm-eval", "results.json", False), "lm-eval", seq),
        metrics(files("bigcode", "metrics.json", True), "bigcode", seq),
        blocks(files("deepeval", "stdout.txt", True), seq),
    )


def task_means(results: DataFrame) -> DataFrame:
    """Mean of each task over its metrics and repeats."""
    return results.groupBy("model", "framework", "task").agg(F.avg("score").alias("task_mean"))


def macro_average(results: DataFrame) -> DataFrame:
    """Unweighted mean of task means for each model and framework. Frameworks have scales of their own and aren't mixed."""
    out = task_means(results).groupBy("model", "framework").agg(F.bround(F.avg("task_mean"), 6).alias("macro"), F.count("*").alias("n_tasks"))
    return out.orderBy("model", "framework")


def top_tasks(results: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    """The k best tasks of each model and framework; of equals, to 9 places, those seen first, and without a place those whose name comes first."""
    first = F.min(seq) if seq in results.columns else F.lit(None).cast("long")
    means = results.groupBy("model", "framework", "task").agg(F.bround(F.avg("score"), 9).alias("mean"), first.alias("first_seq"))
    ranked = Window.partitionBy("model", "framework").orderBy(F.desc("mean"), "first_seq", "task")
    out = means.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("model", "framework", "task", F.bround("mean", 6).alias("task_mean"), "first_seq", "rank")


def judge_pass(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Judge metrics by model and metric: cases, and those that reach the threshold."""
    judged = results.where(F.col("score_type") == "judge")
    return judged.groupBy("model", F.col("category").alias("metric")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("n_passed"))
