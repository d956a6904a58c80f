"""Queries of result files: trees that Spark writes from events, of models whose names have blanks and signs, and what their last runs say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect
from ..sources import readers, result_tree, schemas
from ..streaming import counts
from . import adapters as a
from .registry import query

#: A run for each model and day; a task for each seventh part of the users. Means to a whole number of 10007ths, so that both sides divide alike.
_MODEL = "event_type || ' (32K) 50%+é#' || length(event_type)"
_CELLS = f"""(select {_MODEL} as model, strftime(ts, '%Y%m%d_000000') as run_ts, 'user set ' || (user_id % 7) as task, (sum(event_id) % 10007)::bigint as x, count(*) as n from events group by all)"""
_LAST = f"(select * from {_CELLS} c where run_ts = (select max(run_ts) from {_CELLS} o where o.model = c.model))"


def _row(framework: str, category: str, score: str, kind: str, rows: str = _LAST, extra: str = "") -> str:
    return f"select model, '{framework}' as framework, task, {category} as category, {score}::double as score, '{kind}' as score_type, 0.0::double as tok_per_s from {rows} {extra}"


_X = "round_even(x / 10007.0::double, 4)"
_LM = f"({_row('lm-eval', chr(39) + 'acc' + chr(39), _X, 'accuracy')} union all {_row('lm-eval', chr(39) + 'sound' + chr(39), '(x % 2)', 'accuracy')})"
_BIG = f"({_row('bigcode', chr(39) + 'pass@1' + chr(39), _X, 'pass@1')})"
_DEEP = f"({_row('deepeval', chr(39) + 'relevancy' + chr(39), 'n / 4.0', 'judge')})"
_CUSTOM = f"(select {_MODEL} as model, 'custom' as framework, 'p' || user_id as task, event_type as category, value as score, 'exact' as score_type, (event_id % 50)::double as tok_per_s from events where event_id % 13 not in (0, 1))"
_ALL = f"(select * from {_CUSTOM} union all by name select * from {_LM} union all by name select * from {_BIG} union all by name select * from {_DEEP})"


def _cells(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    model = F.concat("event_type", F.lit(" (32K) 50%+é#"), F.length("event_type").cast("string"))
    keys = [model.alias("model"), F.date_format("ts", "yyyyMMdd_000000").alias("run_ts"), F.concat(F.lit("user set "), (F.col("user_id") % 7).cast("string")).alias("task")]
    return e.groupBy(*keys).agg((F.sum("event_id") % 10007).alias("x"), F.count("*").alias("n"))


def _files(spark, sf_dir, framework: str):
    """model, run_ts, inner, content: the files of one harness."""
    x = F.col("x") / F.lit(10007.0)
    runs = _cells(spark, sf_dir)
    if framework == "deepeval":
        block = F.concat(F.lit('ok {"case_id": "'), "task", F.lit('", "metric": "relevancy", "score": '), (F.col("n") / 4.0).cast("string"), F.lit('}\n{"case_id": broken} '))
        return runs.groupBy("model", "run_ts").agg(F.array_join(F.collect_list(block), " and ").alias("content")).withColumn("inner", F.lit("stdout.txt"))
    if framework == "bigcode":
        metrics = F.to_json(F.struct(x.alias("pass@1"), F.lit("m").alias("model")))
        content = F.concat(F.lit('{"note": "text", "config": {"model": "x"}, '), "body", F.lit("}"))
        inner = F.explode(F.array(F.lit("metrics.json"), F.lit("deep/metrics.json")))  # only the first is in the run's own folder
    else:
        metrics = F.to_json(F.struct(x.alias("acc"), x.alias("acc,none"), F.col("task").alias("alias"), (F.col("x") % 2 == 1).alias("sound")))
        content = F.concat(F.lit('{"results": {'), "body", F.lit("}}"))
        inner = F.lit("a b/results.json")
    body = runs.groupBy("model", "run_ts").agg(F.array_join(F.collect_list(F.concat(F.lit('"'), "task", F.lit('": '), metrics)), ", ").alias("body"))
    return body.select("model", "run_ts", inner.alias("inner"), content.alias("content"))


def _log(spark, sf_dir):
    """events as rows of a run log: some without a score, some with the text None."""
    e = a.table(spark, sf_dir, "events")
    k = F.col("event_id") % 13
    score = F.when(k == 0, "").when(k == 1, "None").otherwise(F.col("value").cast("string"))
    model = F.concat("event_type", F.lit(" (32K) 50%+é#"), F.length("event_type").cast("string"))
    return e.select(
        model.alias("model_label"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt_id"), F.col("event_type").alias("category"), score.alias("score_raw"),
        F.when(k == 0, "invalid").when(k == 1, "needs_judge").otherwise("exact").alias("score_type"), (F.col("event_id") % 50).cast("double").alias("tok_per_s"),
    )


def _tree(spark, sf_dir) -> str:
    root = counts.own_path(spark, "results")
    for framework in ("lm-eval", "bigcode", "deepeval"):
        result_tree.save(_files(spark, sf_dir, framework), f"{root}/{framework}")
    log = _log(spark, sf_dir)
    columns = schemas.struct(schemas.RUN).fields
    readers.replace_csv(log.select(*(F.col(c.name) if c.name in log.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in columns)), f"{root}/runs.csv")
    return root


@query("result_tree", f"select model, run_ts, 'a b/results.json' as inner, max(run_ts) over (partition by model) = run_ts as latest, n_tasks from (select model, run_ts, count(*) as n_tasks from {_CELLS} group by all)")
def tree(spark, sf_dir):
    """Every run of a tree as its own partition, with the place of its file, and how many tasks it has."""
    root = counts.own_path(spark, "results")
    result_tree.save(_files(spark, sf_dir, "lm-eval"), root)
    files = result_tree.load(spark, root, "results.json")
    return files.select("model", "run_ts", "inner", "latest", F.size(F.json_object_keys(F.get_json_object("content", "$.results"))).cast("long").alias("n_tasks"))


@query("collect_custom", f"select * from {_CUSTOM}")
def collect_custom(spark, sf_dir):
    return collect.custom(_log(spark, sf_dir))


def _last(spark, sf_dir, framework: str):
    files = _files(spark, sf_dir, framework).where("not contains(inner, '/') or inner like 'a b/%'")
    last = files.groupBy("model").agg(F.max("run_ts").alias("run_ts"))
    return files.join(last, ["model", "run_ts"])


@query("unpivot_metrics", f"select * from {_LM} union all by name select * from {_BIG}")
def unpivot_metrics(spark, sf_dir):
    return collect.union(*(collect.metrics(_last(spark, sf_dir, f), f) for f in ("lm-eval", "bigcode")))


@query("extract_blocks", f"select * from {_DEEP}")
def extract_blocks(spark, sf_dir):
    return collect.blocks(_last(spark, sf_dir, "deepeval"))


@query("union_collectors", f"select * from {_ALL}")
def union_collectors(spark, sf_dir):
    return collect.union(collect_custom(spark, sf_dir), unpivot_metrics(spark, sf_dir), extract_blocks(spark, sf_dir))


@query("macro_average_collected", f"select model, framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model, framework, task, avg(score) as m from {_ALL} group by 1, 2, 3) group by 1, 2")
def macro_average_collected(spark, sf_dir):
    return collect.macro_average(union_collectors(spark, sf_dir))


@query("judge_pass", f"select model, category as metric, count(*) as n, count(*) filter (score >= 0.5) as n_passed from {_DEEP} group by 1, 2")
def judge_pass(spark, sf_dir):
    return collect.judge_pass(union_collectors(spark, sf_dir))


@query("aggregate_files", f"select * from {_ALL}")
def aggregate_files(spark, sf_dir):
    return collect.aggregate(spark, _tree(spark, sf_dir))


@query("aggregate_macro", f"select model, framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model, framework, task, avg(score) as m from {_ALL} group by 1, 2, 3) group by 1, 2")
def aggregate_macro(spark, sf_dir):
    return collect.macro_average(collect.aggregate(spark, _tree(spark, sf_dir)))


_RANKED = "row_number() over (partition by model, framework order by mean desc, task)::int as rank"
_MEANS = f"(select model, framework, task, round_even(avg(score), 9) as mean from {_ALL} group by 1, 2, 3)"


@query("aggregate_top5", f"select model, framework, task, round_even(mean, 6) as task_mean, rank from (select *, {_RANKED} from {_MEANS}) where rank <= 5")
def aggregate_top5(spark, sf_dir):
    """Ties go by the task's name: what Spark writes has no order of its own."""
    return collect.top_tasks(collect.aggregate(spark, _tree(spark, sf_dir))).drop("first_seq")


_DAY = "substr(run_ts, 7, 2)::int % 4"


@query(
    "skipped_files",
    f"select model, run_ts, 'a b/results.json' as inner, case {_DAY} when 1 then 'not JSON' when 2 then 'no object' else 'empty' end as reason from (select distinct model, run_ts from {_CELLS}) where {_DAY} <> 0",
)
def skipped_files(spark, sf_dir):
    """A tree in which the files of three days in four are broken, each in another way."""
    day = F.substring("run_ts", 7, 2).cast("int") % 4
    broken = F.when(day == 1, F.left("content", F.lit(20))).when(day == 2, F.replace(F.col("content"), F.lit('"results"'), F.lit('"result"'))).when(day == 3, F.lit(" ")).otherwise(F.col("content"))
    root = counts.own_path(spark, "results")
    result_tree.save(_files(spark, sf_dir, "lm-eval").withColumn("content", broken), root)
    return collect.skipped(result_tree.load(spark, root, "results.json"), "lm-eval")
