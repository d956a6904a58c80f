"""Queries of runs, judging, collecting and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as v
from ..functions.rounding import half_even
from ..operators import collect, external, pairs, reports, runs, selection
from ..operators import statistics as st
from ..sources import generators, readers, schemas
from ..streaming import counts
from . import adapters as a
from . import fixtures as f
from .registry import literal, query

_LOG = "(select l_orderkey as prompt_id, l_suppkey as model_label, l_linenumber as repeat, l_extendedprice as score, l_quantity as quantity, l_returnflag as task, l_linestatus as framework from lineitem)"

# --- leaderboards ---------------------------------------------------------------------------------


@query(
    "leaderboard",
    f"""select model_label, count(*) as n_total, count(*) filter (valid) as n_valid, count(score) filter (valid) as n_scored,
    round_even(avg(score) filter (valid), 6) as mean_score from {a.RUNS} group by model_label""",
)
def leaderboard(spark, sf_dir):
    return reports.leaderboard(a.runs(spark, sf_dir))


@query("valid_share", f"select model_label, count(*) as n_total, count(*) filter (valid) as n_valid, {a.mean('score')} as mean_score from {a.GRADED} group by 1")
def valid_share(spark, sf_dir):
    out = a.graded(spark, sf_dir).groupBy("model_label")
    return out.agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_valid"), reports.mean("score").alias("mean_score"))


_CATEGORY = f"(select model_label, category, count(*) as n, round_even(avg(score), 9) as mean from {a.GRADED} where score is not null group by 1, 2)"


@query("category_scores", f"select model_label, category, n, round_even(mean, 6) as mean_score from {_CATEGORY}")
def category_scores(spark, sf_dir):
    return reports.category_scores(a.graded(spark, sf_dir))


@query("category_winner", f"select category, model_label, round_even(mean, 6) as mean_score from {_CATEGORY} qualify row_number() over (partition by category order by mean desc, model_label) = 1")
def category_winner(spark, sf_dir):
    return reports.category_winner(a.graded(spark, sf_dir))


@query(
    "perf_median",
    f"""select model_label, round_even(median(tok_per_s), 6) as median_tok_per_s, round_even(median(total_s), 6) as median_total_s
    from (select *, case when length(response) > 0 then greatest(length(response) // 4, 1) else 0 end / gen_s as tok_per_s from {a.TURNS} where gen_s > 0) group by 1""",
)
def perf_median(spark, sf_dir):
    from ..functions import text as t

    turns = a.turns(spark, sf_dir).where("gen_s > 0")
    return reports.medians(turns.withColumn("tok_per_s", t.rate(t.tokens(F.col("response")), F.col("gen_s"))), "tok_per_s", "total_s")


@query("median_large", f"select task, framework, round_even(median(score), 6) as median_score, round_even(median(quantity), 6) as median_quantity from {_LOG} group by 1, 2")
def median_large(spark, sf_dir):
    """Two medians of a large log for six groups, the largest with half of all rows."""
    found = selection.medians(a.log(spark, sf_dir), ["task", "framework"], "score", "quantity")
    return found.select("task", "framework", *(F.bround(f"median_{c}", 6).alias(f"median_{c}") for c in ("score", "quantity")))


@query(
    "invalid_breakdown",
    f"""select model_label, reason, count(*) as n from (select model_label, case when finish_reason = 'error' then 'error' when {a.strip('response')} = '' then 'empty'
    when finish_reason = 'length' and category is distinct from 'creative' then 'length' end as reason from {a.RESPONSES}) where reason is not null group by 1, 2""",
)
def invalid_breakdown(spark, sf_dir):
    from ..functions import text as t

    return reports.invalid_breakdown(a.responses(spark, sf_dir).withColumn("answer", t.strip("response")))


_SUMMARY = f"(select model_label, {a.mean('score')} as mean_score from {a.RUNS} group by 1)"


@query(
    "baseline_delta",
    f"""select s.model_label, s.mean_score, round_even(s.mean_score - b.mean_score, 6) as delta, case when b.mean_score <> 0 then round_even(s.mean_score / b.mean_score, 6) end as ratio
    from {_SUMMARY} s, {_SUMMARY} b where b.model_label = 'click'""",
)
def baseline_delta(spark, sf_dir):
    return reports.baseline_delta(a.runs(spark, sf_dir).groupBy("model_label").agg(reports.mean("score").alias("mean_score")), "click")


# --- runs -----------------------------------------------------------------------------------------


def _best(spark, sf_dir):
    return runs.best_repeat(a.runs(spark, sf_dir), ["prompt_id", "model_label"])


@query("best_repeat", f"select prompt_id, model_label, seq, score from {a.BEST}")
def best_repeat(spark, sf_dir):
    return _best(spark, sf_dir).select("prompt_id", "model_label", "seq", "score")




@query(
    "best_repeat_large",
    f"""select prompt_id, repeat, score, quantity from {_LOG} qualify row_number() over (partition by prompt_id order by score desc nulls last, repeat nulls first, quantity nulls first, task nulls first, framework nulls first) = 1""",
)
def best_repeat_large(spark, sf_dir):
    best = runs.best_repeat(a.log(spark, sf_dir), ["prompt_id"], order=["repeat", "quantity", "task", "framework"])
    return best.select("prompt_id", "repeat", "score", "quantity")


@literal("needs_judge", f"select model_label, count(*) as n from {a.values([r[:6] for r in f.RUN_ROWS], 'model_label', 'prompt_id', 'category', 'score_raw', 'score_type', 'tok')} where score_type is null or score_type = 'needs_judge' group by 1")
def needs_judge(spark, sf_dir):
    return _run_rows(spark).where(runs.needs_judge(F.col("score_type"))).groupBy("model_label").agg(F.count("*").alias("n"))


@query(
    "sanity_prefix",
    f"""select model_label, count(*) as n_opening, count(*) = 3 and bool_and(score < 50) as abort from (select *, row_number() over (partition by model_label order by seq) as n from {a.RUNS}) where n <= 3 group by 1""",
)
def sanity_prefix(spark, sf_dir):
    return runs.opening_is_empty(a.runs(spark, sf_dir), ["model_label"], F.col("score") < 50, "seq")


@literal(
    "work_list",
    f"""select c.id, m.label, r as repeat, case when c.category = 'creative' then [41, 42, 43][r] else 42 end as seed
    from {a.values([(x[0], x[1]) for x in f.CASES], 'id', 'category')} c, {a.values([(x[0],) for x in f.MODELS], 'label')} m, (select unnest([1, 2, 3])::int as r)""",
)
def work_list(spark, sf_dir):
    cases = spark.createDataFrame([(x[0], x[1]) for x in f.CASES], "id string, category string")
    return runs.work_list(cases, spark.createDataFrame([(x[0],) for x in f.MODELS], "label string")).select("id", "label", "repeat", "seed")


@literal(
    "run_projection",
    f"""select id, coalesce(temperature, 0.0)::double as temperature, coalesce(max_tokens, 512)::int as max_tokens, case when category = 'creative' then 0.95 else 1.0 end::double as top_p
    from {a.values(f.CASES, 'id', 'category', 'temperature', 'max_tokens', 'scoring')}""",
)
def run_projection(spark, sf_dir):
    return runs.declared(spark.createDataFrame(f.CASES, "id string, category string, temperature double, max_tokens int, scoring string")).select("id", "temperature", "max_tokens", "top_p")


@literal("model_check", f"select label, served_model from {a.values(f.MODELS, 'label', 'served_model', 'quant')} where served_model not in (select s from {a.values(f.SERVED, 's')})")
def model_check(spark, sf_dir):
    required = spark.createDataFrame(f.MODELS, "label string, served_model string, quant string")
    return runs.missing_models(required, spark.createDataFrame(f.SERVED, "served_model string")).select("label", "served_model")


@query("latest_run", "with r as (select event_type as model, strftime(ts, '%Y%m%d_%H%M%S') as run_ts, event_id from events) select model, run_ts, event_id from r join (select model, max(run_ts) as run_ts from r group by 1) using (model, run_ts)")
def latest_run(spark, sf_dir):
    files = a.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), runs.run_stamp(F.col("ts")).alias("run_ts"), "event_id")
    return runs.latest_run(files)


@literal(
    "prompt_sweep",
    f"""select t::int as target_tokens, case when t <= 50 then {a.literal(generators.SHORT_PROMPT)} else {a.literal(generators.OPENING)}
    || left(repeat({a.literal(generators.BLOCK)}, greatest((t * 4) // {len(generators.BLOCK)}, 1)::int), (t * 4)::int) || {a.literal(generators.CLOSING)} end as prompt
    from (select unnest({list(generators.TARGETS)}) as t)""",
)
def prompt_sweep(spark, sf_dir):
    return generators.sweep(spark)


@literal("model_catalogue", f"select 'model' as kind, label as name, served_model, quant from {a.values(f.MODELS, 'label', 'served_model', 'quant')} union all select 'lm-eval', 'ifeval', null, null")
def model_catalogue(spark, sf_dir):
    return generators.catalogue(spark, {m: {"served_model": s, "quant": q} for m, s, q in f.MODELS}, {"lm-eval": ["ifeval"]})


@query(
    "session_leaderboard",
    f"""select model_label, count(*) as n_total, count(*) filter (valid) as n_valid, count(score) filter (valid) as n_scored, round_even(avg(score) filter (valid), 6) as mean_score
    from {a.RUNS} where strftime(arrival, '%Y%m') = (select max(strftime(ts, '%Y%m')) from events) group by 1""",
)
def session_leaderboard(spark, sf_dir):
    log = a.runs(spark, sf_dir).withColumn("bench_run_id", F.date_format("arrival", "yyyyMM"))
    last = F.broadcast(log.agg(F.max("bench_run_id").alias("last")))  # one row
    return reports.leaderboard(runs.session(log.crossJoin(last), F.col("last")))


@query("warm_up_filter", "select count(*) as n, sum(l_linenumber)::bigint as repeats from lineitem where l_linenumber - 2 > 0")
def warm_up_filter(spark, sf_dir):
    log = a.log(spark, sf_dir).withColumn("call", F.col("repeat") - 2)  # the first two calls warm up
    return runs.scored_only(log, "call").agg(F.count("*").alias("n"), F.sum("repeat").alias("repeats"))


@query("registry_lookup", "select s_suppkey as model_label, n_name as served_model, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2")
def registry_lookup(spark, sf_dir):
    registry = a.table(spark, sf_dir, "supplier").join(a.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("model_label"), F.col("n_name").alias("served_model"))
    return runs.registered(a.log(spark, sf_dir), registry).groupBy("model_label", "served_model").agg(F.count("*").alias("n"))


@query(
    "progress_counts",
    f"""with p as (select distinct user_id from events), b as (select distinct prompt_id from {a.RUNS} where valid and score > 90), j as (select distinct prompt_id from {a.RUNS} where valid and score > 95)
    select count(*) as prompts, count(b.prompt_id) as answered, count(j.prompt_id) as judged, count(*) - count(j.prompt_id) as skipped from p left join b on b.prompt_id = user_id left join j on j.prompt_id = user_id""",
)
def progress_counts(spark, sf_dir):
    log = a.runs(spark, sf_dir)
    return runs.progress(log, log.where("valid and score > 90"), log.where("valid and score > 95"))


@query("shortened_output", "select doc_id, right(text, 2000) as tail, left(text, 200) as head from documents")
def shortened_output(spark, sf_dir):
    docs = a.table(spark, sf_dir, "documents")
    return docs.select("doc_id", runs.shortened(F.col("text"), last=2000).alias("tail"), runs.shortened(F.col("text"), first=200).alias("head"))


def _exact(x: str, places: int) -> str:
    """x >= 0 rounded by whole numbers alone: its double times 2^60 is one, for x of 2^-8 and more."""
    y = f"(({x} * 1152921504606846976.0::double)::hugeint * {10**places})"
    whole, rest = f"({y} // 1152921504606846976)", f"({y} % 1152921504606846976)"
    return f"(({whole} + case when {rest} > 576460752303423488 or ({rest} = 576460752303423488 and {whole} % 2 = 1) then 1 else 0 end)::double / {10**places})"


# halves of values, most of them between two digits, with the double before and after: all that decides is in the last bits
_NEAR = "(select event_id, event_type, user_id, value, value + 0.005 as up, 8 + (event_id * 10 + 5) / 1000.0::double as half from events)"


@query(
    "rounded_metrics",
    f"""select event_id, {_exact('value', 1)} as one, {_exact('value', 2)} as two, {_exact('value', 4)} as four, {_exact('up', 2)} as up_two, {_exact('half', 2)} as half_two,
    '["' || event_type || '","' || user_id || '"]' as encoded from {_NEAR}""",
)
def rounded_metrics(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    near = [half_even(F.col("value") + 0.005, 2).alias("up_two"), half_even(8 + (F.col("event_id") * 10 + 5) / F.lit(1000.0), 2).alias("half_two")]
    return e.select("event_id", *near, *(half_even(F.col("value"), n).alias(c) for n, c in ((1, "one"), (2, "two"), (4, "four"))), F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("encoded"))


# --- judging --------------------------------------------------------------------------------------

_LABELS = f"(select list_sort(list(distinct model_label))[1] as l, list_sort(list(distinct model_label))[2] as r from {a.RUNS})"
_PAIRS = f"""(select x.prompt_id, l as model_a, r as model_b, x.score as a, y.score as b from {_LABELS} n join {a.BEST} x on x.model_label = l join {a.BEST} y on y.model_label = r and x.prompt_id = y.prompt_id)"""


@query("pairwise_join", f"select * from {_PAIRS}")
def pairwise_join(spark, sf_dir):
    return pairs.pairs(_best(spark, sf_dir))


@query(
    "pairwise_missing",
    f"""select prompt_id, coalesce(bool_or(model_label = l), false) as has_a, coalesce(bool_or(model_label = r), false) as has_b from {a.BEST}, {_LABELS} n
    group by 1 having not (has_a and has_b)""",
)
def pairwise_missing(spark, sf_dir):
    return pairs.missing(_best(spark, sf_dir))


@query("head_to_head", f"select model_a, model_b, count(*) filter (a > b) as wins, count(*) filter (a < b) as losses, count(*) filter (a = b) as ties from {_PAIRS} where a is not null and b is not null group by 1, 2")
def head_to_head(spark, sf_dir):
    return pairs.head_to_head(pairs.pairs(_best(spark, sf_dir)))


@query("blind_order", "select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 2 = 1 as swapped from documents")
def blind_order(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", v.swapped(F.col("doc_id")).alias("swapped"))


@query(
    "pair_prompt",
    """select doc_id, sha256('## Task' || chr(10) || lang || chr(10) || chr(10) || '## Candidate A' || chr(10) || text || chr(10) || chr(10) || '## Candidate B' || chr(10) || source || chr(10) || chr(10)
    || 'Evaluate both candidates against the task. Score each using the rubric.' || chr(10) || 'Respond with ONLY the JSON object.') as digest from documents""",
)
def pair_prompt(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", F.sha2(v.prompt(F.col("lang"), F.col("text"), F.col("source")), 256).alias("digest"))


def _answers(spark):
    return spark.createDataFrame(f.ANSWERS, "prompt_id string, category string, swapped boolean, answer string").withColumn("v", v.parse(F.col("answer")))


_V = f"""(select *, case when json_valid(x) and regexp_replace(x, '\\s', '', 'g') <> '{{}}' then x end as j from (select *, regexp_extract(
    case when starts_with({a.strip('answer')}, '```') then regexp_replace(split_part({a.strip('answer')}, '```', 2), '^json', '') else {a.strip('answer')} end, '(?s)\\{{.*\\}}', 0) as x
    from {a.values(f.ANSWERS, 'prompt_id', 'category', 'swapped', 'answer')}) where json_valid(x))"""
_FIELDS = "json_extract_string(j, '$.winner') as w, json_extract_string(j, '$.a_score')::double as sa, json_extract_string(j, '$.b_score')::double as sb, coalesce(json_extract(j, '$.violations.A')::varchar, '[]') as va, coalesce(json_extract(j, '$.violations.B')::varchar, '[]') as vb"


@literal("parse_verdict", f"select prompt_id, w as winner, sa as a_score, sb as b_score from (select prompt_id, {_FIELDS} from {_V} where j is not null)")
def parse_verdict(spark, sf_dir):
    return _answers(spark).where("v is not null").select("prompt_id", "v.winner", "v.a_score", "v.b_score")


_UNSWAPPED = f"""(select prompt_id, category, case when swapped then case w when 'A' then 'B' when 'B' then 'A' else 'tie' end else coalesce(w, 'tie') end as winner,
    coalesce(case when swapped then sb else sa end, 0) as a_score, coalesce(case when swapped then sa else sb end, 0) as b_score,
    case when swapped then vb else va end as violations_a, case when swapped then va else vb end as violations_b from (select prompt_id, category, swapped, {_FIELDS} from {_V} where j is not null))"""


def _judged(spark):
    return _answers(spark).where("v is not null").select("prompt_id", "category", v.unswap(F.col("v"), F.col("swapped")).alias("u")).select("prompt_id", "category", "u.*")


@literal("unswap", f"select * from {_UNSWAPPED}")
def unswap(spark, sf_dir):
    return _judged(spark)


_VERDICTS = f"(select prompt_id, case when prompt_id % 5 < 2 then 'en' else 'fr' end as category, case when a > b then 'A' when a < b then 'B' else 'tie' end as winner, a as a_score, b as b_score from {_PAIRS})"


def _verdicts(spark, sf_dir):
    p = pairs.pairs(_best(spark, sf_dir))
    return p.select(
        "prompt_id", F.when(F.col("prompt_id") % 5 < 2, "en").otherwise("fr").alias("category"), F.when(F.col("a") > F.col("b"), "A").when(F.col("a") < F.col("b"), "B").otherwise("tie").alias("winner"),
        F.col("a").alias("a_score"), F.col("b").alias("b_score"),
    )


@query("verdict_totals", f"select winner, count(*) as n from {_VERDICTS} group by 1")
def verdict_totals(spark, sf_dir):
    return pairs.totals(_verdicts(spark, sf_dir))


@query("verdict_means", f"select count(*) as n, {a.mean('a_score')} as mean_a, {a.mean('b_score')} as mean_b from {_VERDICTS}")
def verdict_means(spark, sf_dir):
    return pairs.means(_verdicts(spark, sf_dir))


@query("verdict_pivot", f'select category, count(*) filter (winner = \'A\') as "A", count(*) filter (winner = \'B\') as "B", count(*) filter (winner = \'tie\') as tie from {_VERDICTS} group by 1')
def verdict_pivot(spark, sf_dir):
    return pairs.by_category(_verdicts(spark, sf_dir))


# --- collecting -----------------------------------------------------------------------------------


def _run_rows(spark):
    return spark.createDataFrame(f.RUN_ROWS, "model_label string, prompt_id string, category string, score_raw string, score_type string, tok_per_s string, seq long")


def _files(spark, rows):
    return runs.latest_run(spark.createDataFrame(rows, "model string, run_ts string, inner string, content string"))


_CUSTOM = f"""(select model_label as model, 'custom' as framework, prompt_id as task, category, score_raw::double as score, score_type, coalesce(try_cast(tok as double), 0) as tok_per_s
    from {a.values(f.RUN_ROWS, 'model_label', 'prompt_id', 'category', 'score_raw', 'score_type', 'tok', 'seq')} where score_raw <> '' and score_raw <> 'None')"""


def _latest(rows):
    t = a.values(rows, "model", "run_ts", "inner_", "content")
    return f"(select * from {t} t where run_ts = (select max(run_ts) from {t} u where u.model = t.model))"


def _unpivot(rows, framework, score_type, root, extra):
    return f"""(select model, '{framework}' as framework, task, metric as category, round_even(case json_type(value) when 'BOOLEAN' then (value::varchar)::boolean::int::double else value::double end, 4) as score, '{score_type}' as score_type, 0.0::double as tok_per_s
    from (select model, task, metric, json_extract(o, '$."' || metric || '"') as value from (select model, task, o, unnest(json_keys(o)) as metric from
      (select model, task, json_extract(j, '$."' || task || '"') as o from (select model, j, unnest(json_keys(j)) as task from (select model, {root} as j from {_latest(rows)} where json_valid(content)))) where json_type(o) = 'OBJECT'))
    where json_type(value) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') {extra})"""


LM_ROOT, LM_RULE = "json_extract(content, '$.results')", "and not ends_with(metric, ',none') and metric <> 'alias'"
_LM = _unpivot(f.LM_EVAL, "lm-eval", "accuracy", LM_ROOT, LM_RULE)
_BIG = _unpivot(f.BIGCODE, "bigcode", "pass@1", "content::json", "")
_DEEP = rf"""(select model, 'deepeval' as framework, coalesce(json_extract_string(b, '$.case_id'), 'unknown') as task, coalesce(json_extract_string(b, '$.metric'), '') as category,
    try_cast(coalesce(json_extract_string(b, '$.score'), '0') as double) as score, 'judge' as score_type, 0.0::double as tok_per_s
    from (select model, unnest(regexp_extract_all(content, '\{{[^{{}}]*"case_id"[^{{}}]*\}}')) as b from {_latest(f.PYTEST)}) where json_valid(b) and try_cast(coalesce(json_extract_string(b, '$.score'), '0') as double) is not null)"""
_UNION = f"(select * from {_CUSTOM} union all by name select * from {_LM} union all by name select * from {_BIG} union all by name select * from {_DEEP})"


@literal("collect_custom", f"select * from {_CUSTOM}")
def collect_custom(spark, sf_dir):
    return collect.custom(_run_rows(spark))


@literal("unpivot_metrics", f"select * from {_LM} union all by name select * from {_BIG}")
def unpivot_metrics(spark, sf_dir):
    return collect.union(collect.metrics(_files(spark, f.LM_EVAL), "lm-eval"), collect.metrics(_files(spark, f.BIGCODE), "bigcode"))


@literal("extract_blocks", f"select * from {_DEEP}")
def extract_blocks(spark, sf_dir):
    return collect.blocks(_files(spark, f.PYTEST))


def _union(spark):
    return collect.union(collect_custom(spark, ""), unpivot_metrics(spark, ""), extract_blocks(spark, ""))


@literal("union_collectors", f"select * from {_UNION}")
def union_collectors(spark, sf_dir):
    return _union(spark)


@literal("macro_average_collected", f"select model, framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model, framework, task, avg(score) as m from {_UNION} group by 1, 2, 3) group by 1, 2")
def macro_average_collected(spark, sf_dir):
    return collect.macro_average(_union(spark))


@literal("judge_pass", f"select model, category as metric, count(*) as n, count(*) filter (score >= 0.5) as n_passed from {_DEEP} group by 1, 2")
def judge_pass(spark, sf_dir):
    return collect.judge_pass(_union(spark))


def _tree(spark) -> str:
    """The literal results as files: a run log and a folder for each framework, model and run."""
    root = counts.own_path(spark, "results")
    quoted = lambda v: "" if v is None else str(v)
    log = [("model_label", "prompt_id", "category", "score_raw", "score_type", "tok_per_s"), *(r[:6] for r in f.RUN_ROWS)]
    names = [x.name for x in schemas.struct(schemas.RUN).fields]
    lines = [",".join(quoted(dict(zip(log[0], r, strict=True)).get(c)) for c in names) for r in log[1:]]
    readers.write_text(spark, "\n".join([",".join(names), *lines, ""]), f"{root}/runs.csv")
    for framework, rows in (("lm-eval", f.LM_TREE), ("bigcode", f.BIG_TREE), ("deepeval", f.PYTEST)):
        for model, run, inner, content in rows:
            readers.write_text(spark, content, f"{root}/{framework}/{model}/{run}/{inner}")
    return root


_TREE = f"(select * from {_CUSTOM} union all by name select * from {_unpivot(f.LM_TREE, 'lm-eval', 'accuracy', LM_ROOT, LM_RULE)} union all by name select * from {_BIG} union all by name select * from {_DEEP})"


@literal("aggregate_files", f"select * from {_TREE}")
def aggregate_files(spark, sf_dir):
    return collect.aggregate(spark, _tree(spark))


@literal("aggregate_macro", f"select model, framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model, framework, task, avg(score) as m from {_TREE} group by 1, 2, 3) group by 1, 2")
def aggregate_macro(spark, sf_dir):
    return collect.macro_average(collect.aggregate(spark, _tree(spark)))


# no task of the literal rows ties with another but in the run log, where the first seen is the first by name
@literal("aggregate_top5", f"select model, framework, task, round_even(mean, 6) as task_mean, row_number() over (partition by model, framework order by mean desc, task)::int as rank from (select model, framework, task, round_even(avg(score), 9) as mean from {_TREE} group by 1, 2, 3) qualify rank <= 5")
def aggregate_top5(spark, sf_dir):
    return collect.top_tasks(collect.aggregate(spark, _tree(spark), seq=True)).drop("first_seq")


def _as_results(df, model, framework, task, score, seq):
    return df.select(F.col(model).cast("string").alias("model"), F.col(framework).cast("string").alias("framework"), F.col(task).cast("string").alias("task"), F.col(score).alias("score"), F.col(seq).alias("seq"))


@query("macro_average", f"select model_label as model, 'events' as framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model_label, prompt_id, avg(score) as m from {a.RUNS} group by 1, 2) group by 1")
def macro_average(spark, sf_dir):
    return collect.macro_average(_as_results(a.runs(spark, sf_dir).withColumn("framework", F.lit("events")), "model_label", "framework", "prompt_id", "score", "seq"))


_TOP = "select model, framework, task, round_even(mean, 6) as task_mean, first_seq, row_number() over (partition by model, framework order by mean desc, first_seq, task)::int as rank from (select {m}::varchar as model, {f} as framework, {t}::varchar as task, round_even(avg(score), 9) as mean, min({s}) as first_seq from {x} group by 1, 2, 3) qualify rank <= 5"


@query("top5_tasks", _TOP.format(m="model_label", f="'events'", t="prompt_id", s="seq", x=a.RUNS))
def top5_tasks(spark, sf_dir):
    return collect.top_tasks(_as_results(a.runs(spark, sf_dir).withColumn("framework", F.lit("events")), "model_label", "framework", "prompt_id", "score", "seq"))


@query("macro_average_large", f"select model_label::varchar as model, framework, round_even(avg(m), 6) as macro, count(*) as n_tasks from (select model_label, framework, task, avg(score) as m from {_LOG} group by 1, 2, 3) group by 1, 2")
def macro_average_large(spark, sf_dir):
    return collect.macro_average(_as_results(a.log(spark, sf_dir), "model_label", "framework", "task", "score", "repeat"))


@query("top5_large", _TOP.format(m="task", f="framework", t="model_label", s="prompt_id", x=_LOG))
def top5_large(spark, sf_dir):
    return collect.top_tasks(_as_results(a.log(spark, sf_dir), "task", "framework", "model_label", "score", "prompt_id"))


# --- statistics -----------------------------------------------------------------------------------


@query(
    "sign_test",
    f"""with s as (select count(*) filter (a > b) as n_pos, count(*) filter (a < b) as n_neg from {_PAIRS}),
    t as (select n_pos, n_neg, sum(exp(lgamma(n_pos + n_neg + 1) - lgamma(k + 1) - lgamma(n_pos + n_neg - k + 1) - (n_pos + n_neg) * ln(2))) as tail from s, range(0, least(n_pos, n_neg) + 1) r(k) group by 1, 2)
    select n_pos, n_neg, round_even(least(1, 2 * tail), 6) as p_value from t""",
)
def sign_test(spark, sf_dir):
    return st.sign_test(pairs.pairs(_best(spark, sf_dir)))


@query(
    "wilcoxon",
    f"""with d as (select round_even(a - b, 9) as d from {_PAIRS} where a <> b), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by abs(d)) as t from d where d <> 0),
    s as (select count(*) as n, coalesce(sum(rk) filter (d > 0), 0)::double as w_plus, coalesce(sum(rk) filter (d < 0), 0)::double as w_minus, sum(t * t - 1)::double as ties from r)
    select n, w_plus, w_minus, round_even((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) as z from s""",
)
def wilcoxon(spark, sf_dir):
    return st.wilcoxon(pairs.pairs(_best(spark, sf_dir)))


@query(
    "bootstrap_ci",
    f"""with u as (select a - b as d, r, ('0x' || substr(md5(prompt_id::varchar || ':' || r::varchar), 1, 8))::bigint / 4294967296.0::double as u from {_PAIRS}, range(1, 201) x(r)),
    w as (select d, r, (u >= 0.367879)::int + (u >= 0.735759)::int + (u >= 0.919699)::int + (u >= 0.981012)::int + (u >= 0.99634)::int + (u >= 0.999406)::int as w from u),
    m as (select r, round_even(sum(w * d) / sum(w), 6) as m from w group by r)
    select round_even(quantile_cont(m, 0.025), 6) as low, round_even(quantile_cont(m, 0.975), 6) as high, count(*) as resamples from m""",
)
def bootstrap_ci(spark, sf_dir):
    return st.bootstrap_ci(pairs.pairs(_best(spark, sf_dir)), "prompt_id")


# --- outside effects ------------------------------------------------------------------------------


@literal("unit_tests_exec", f"select id::bigint as id, response, test_code, unit_score::double as unit_score from {a.values([(*r, s) for r, s in zip(f.CODE, f.CODE_SCORES, strict=True)], 'id', 'response', 'test_code', 'unit_score')}")
def unit_tests_exec(spark, sf_dir):
    rows = spark.createDataFrame(f.CODE, "id long, response string, test_code string")
    return external.unit_tests(rows, enabled=True, seconds=2)


@literal("judge_provider", f"select prompt_id, x as answer from {a.values([(p, x) for p, _, _, x in f.ANSWERS], 'prompt_id', 'x')} where x <> ''")
def judge_provider(spark, sf_dir):
    shown = spark.createDataFrame([(p,) for p, *_ in f.ANSWERS], "prompt_id string")
    record = spark.createDataFrame([(p, x if i % 2 else "", x) for i, (p, _, _, x) in enumerate(f.ANSWERS)], "prompt_id string, primary_answer string, tiebreak_answer string")
    return external.recorded(shown, record)
