"""Queries whose shapes the tables lack, on rows that Spark derives from the tables. Their literal rows are tests, see registry.literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..functions import verdicts as v
from ..operators import external, runs
from ..sources import generators, readers
from ..streaming import sse
from . import adapters as a
from . import fixtures as f
from .registry import LITERALS, query
from .scoring_queries import _constraints


def _twin(name: str, literal_rows: str, rows: str) -> str:
    """The twin of the literal query over other rows."""
    sql = LITERALS[name][1]
    if literal_rows not in sql:
        raise ValueError(f"{name} doesn't read these rows")
    return sql.replace(literal_rows, rows)


def _case(key: Column, *values: Column) -> Column:
    """The value for key = 0, 1, ...; the last for all others."""
    out = values[-1]
    for i, x in reversed(list(enumerate(values[:-1]))):
        out = F.when(key == i, x).otherwise(out)
    return out


# --- runs -----------------------------------------------------------------------------------------

_K = "cast(json_extract_string(props, '$.k') as int)"


def _events(spark, sf_dir) -> DataFrame:
    return a.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("needs_judge", f"select event_type as model_label, count(*) as n from events where {_K} % 4 in (0, 1) group by 1")
def needs_judge(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("score_type", _case(F.col("k") % 4, F.lit(None).cast("string"), F.lit("needs_judge"), F.lit("invalid"), F.lit("exact")))
    return rows.where(runs.needs_judge(F.col("score_type"))).groupBy(F.col("event_type").alias("model_label")).agg(F.count("*").alias("n"))


_CASES = "(select doc_id as id, case when lang = 'fr' then 'creative' else lang end as category, case when doc_id % 3 > 0 then doc_id % 5 / 4.0 end as temperature, case when doc_id % 4 > 0 then n_chars end as max_tokens from documents)"


def _cases(spark, sf_dir) -> DataFrame:
    """documents as cases, their sampling only declared in part."""
    d = a.table(spark, sf_dir, "documents")
    category = F.when(F.col("lang") == "fr", "creative").otherwise(F.col("lang"))
    return d.select(F.col("doc_id").alias("id"), category.alias("category"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5 / 4).alias("temperature"), F.when(F.col("doc_id") % 4 > 0, F.col("n_chars").cast("int")).alias("max_tokens"))


@query("run_projection", f"select id, coalesce(temperature, 0.0)::double as temperature, coalesce(max_tokens, 512)::int as max_tokens, case when category = 'creative' then 0.95 else 1.0 end::double as top_p from {_CASES}")
def run_projection(spark, sf_dir):
    return runs.declared(_cases(spark, sf_dir)).select("id", "temperature", "max_tokens", "top_p")


@query(
    "work_list",
    f"""select c.id, m.label, r as repeat, case when c.category = 'creative' then [41, 42, 43][r] else 42 end as seed
    from {_CASES} c, (select distinct event_type as label from events) m, (select unnest([1, 2, 3])::int as r)""",
)
def work_list(spark, sf_dir):
    models = a.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    return runs.work_list(_cases(spark, sf_dir), models).select("id", "label", "repeat", "seed")


@query("model_check", "select s_name as label, n_name as served_model from supplier join nation on n_nationkey = s_nationkey where n_nationkey not in (select s_nationkey from supplier where s_acctbal >= 5000)")
def model_check(spark, sf_dir):
    suppliers = a.table(spark, sf_dir, "supplier").join(a.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    served = suppliers.where("s_acctbal >= 5000").select(F.col("n_name").alias("served_model")).distinct()
    return runs.missing_models(suppliers.select(F.col("s_name").alias("label"), F.col("n_name").alias("served_model")), served).select("label", "served_model")


@query("model_catalogue", "select 'model' as kind, s_name as name, n_name as served_model, null as quant from supplier join nation on n_nationkey = s_nationkey union all select distinct lang, source, null, null from documents where lang is not null")
def model_catalogue(spark, sf_dir):
    models = a.table(spark, sf_dir, "supplier").join(a.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    tasks = a.table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("framework"), F.col("source").alias("task"))
    return generators.listed(models.select(F.col("s_name").alias("name"), F.col("n_name").alias("served_model"), F.lit(None).cast("string").alias("quant")), tasks)


_TOKENS = "case when length(text) > 0 then greatest(length(text) // 4, 1) else 0 end"


@query(
    "prompt_sweep",
    f"""select t::int as target_tokens, case when t <= {generators.SHORT_TOKENS} then {a.literal(generators.SHORT_PROMPT)} else {a.literal(generators.OPENING)}
    || left(repeat({a.literal(generators.BLOCK)}, greatest((t * 4) // {len(generators.BLOCK)}, 1)::int), (t * 4)::int) || {a.literal(generators.CLOSING)} end as prompt
    from (select distinct {_TOKENS} as t from documents where text is not null)""",
)
def prompt_sweep(spark, sf_dir):
    lengths = a.table(spark, sf_dir, "documents").where("text is not null").select(t.tokens(F.col("text")).alias("target_tokens")).distinct()
    return generators.prompts(lengths)


# --- judging --------------------------------------------------------------------------------------

_WINNERS, _FENCE = ["A", "B", "tie", "C"], "```"
_JSON = f"""'{{"winner": "' || {a.literal(_WINNERS)}[{_K} % 4 + 1] || '", "a_score": ' || {_K} % 6 || case when {_K} % 5 > 0 then ', "b_score": ' || event_id % 6 else '' end || ', "violations": {{"A": [], "B": ["' || event_type || '"]}}}}'"""
_ANSWERS = f"""(select event_id::varchar as prompt_id, event_type as category, user_id % 2 = 1 as swapped, case event_id % 7 when 0 then '{_FENCE}json' || chr(10) || x || chr(10) || '{_FENCE}' when 1 then 'My verdict: ' || x || ' as said' when 2 then '' when 3 then event_type
    when 4 then '{{"winner": "B"' else x end as answer from (select *, {_JSON} as x from events))"""
_ANSWER_ROWS = a.values(f.ANSWERS, "prompt_id", "category", "swapped", "answer")


def _answers(spark, sf_dir) -> DataFrame:
    """events as answers of a judge: plain, fenced, with words around them, empty, without a verdict or cut off."""
    b = F.when(F.col("k") % 5 > 0, F.concat(F.lit(', "b_score": '), (F.col("event_id") % 6).cast("string"))).otherwise("")
    winner = F.element_at(F.array(*map(F.lit, _WINNERS)), F.col("k") % 4 + 1)
    x = F.concat(F.lit('{"winner": "'), winner, F.lit('", "a_score": '), (F.col("k") % 6).cast("string"), b, F.lit(', "violations": {"A": [], "B": ["'), "event_type", F.lit('"]}}'))
    told = _case(F.col("event_id") % 7, F.concat(F.lit(f"{_FENCE}json\n"), x, F.lit(f"\n{_FENCE}")), F.concat(F.lit("My verdict: "), x, F.lit(" as said")), F.lit(""), F.col("event_type"), F.lit('{"winner": "B"'), x)
    return _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("prompt_id"), F.col("event_type").alias("category"), (F.col("user_id") % 2 == 1).alias("swapped"), told.alias("answer"))


@query("parse_verdict", _twin("parse_verdict", _ANSWER_ROWS, _ANSWERS))
def parse_verdict(spark, sf_dir):
    return _answers(spark, sf_dir).withColumn("v", v.parse(F.col("answer"))).where("v is not null").select("prompt_id", "v.winner", "v.a_score", "v.b_score")


@query("unswap", _twin("unswap", _ANSWER_ROWS, _ANSWERS))
def unswap(spark, sf_dir):
    told = _answers(spark, sf_dir).withColumn("v", v.parse(F.col("answer"))).where("v is not null")
    return told.select("prompt_id", "category", v.unswap(F.col("v"), F.col("swapped")).alias("u")).select("prompt_id", "category", "u.*")


@query("judge_provider", f"select prompt_id, answer from {_ANSWERS} where answer <> ''")
def judge_provider(spark, sf_dir):
    # every third pair has nothing from the first judge
    told = _answers(spark, sf_dir)
    record = told.select("prompt_id", F.when(F.col("prompt_id").cast("long") % 3 > 0, F.col("answer")).otherwise("").alias("primary_answer"), F.col("answer").alias("tiebreak_answer"))
    return external.recorded(told.select("prompt_id"), record)


_UNITS = "(select s_suppkey as id, 'def f(x):' || chr(10) || '    return x * ' || s_nationkey as response, 'assert f(3) == ' || case when s_suppkey % 4 = 0 then 3 * s_nationkey + 1 else 3 * s_nationkey end as test_code from supplier)"


@query("unit_tests_exec", f"select id, response, test_code, case when id % 4 = 0 then 1 else 5 end::double as unit_score from {_UNITS}")
def unit_tests_exec(spark, sf_dir):
    wanted = F.col("s_nationkey") * 3 + F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)
    suppliers = readers.balanced(a.table(spark, sf_dir, "supplier"))  # each row is a process of its own, which is worth a shuffle of one file
    rows = suppliers.select(
        F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("def f(x):\n    return x * "), F.col("s_nationkey").cast("string")).alias("response"), F.concat(F.lit("assert f(3) == "), wanted.cast("string")).alias("test_code")
    )
    return external.unit_tests(rows, enabled=True, seconds=10)


# --- scoring --------------------------------------------------------------------------------------

_GUESSES = "(select event_id as id, event_type as expected, case event_id % 6 when 0 then '`' || event_type || '`' when 1 then '  ' || event_type || chr(10) when 2 then 'It is ' || event_type || ', I think' when 3 then upper(event_type) when 4 then 'none' else event_type end as response from events)"


@query("score_exact_cases", _twin("score_exact_cases", a.values(f.EXACT, "id", "response", "expected"), _GUESSES))
def score_exact_cases(spark, sf_dir):
    x = F.col("event_type")
    guess = _case(F.col("event_id") % 6, F.concat(F.lit("`"), x, F.lit("`")), F.concat(F.lit("  "), x, F.lit("\n")), F.concat(F.lit("It is "), x, F.lit(", I think")), F.upper(x), F.lit("none"), x)
    return a.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), s.exact(guess, x).alias("score"))


#: Lines of a text as bullets; the first stays plain, and every third text is cut to pairs of words.
_LISTS = "(select doc_id as id, replace(case when doc_id % 3 = 0 then regexp_replace(text, '([^ \\n]+ [^ \\n]+) ', '\\1' || chr(10), 'g') else text end, chr(10), chr(10) || case when doc_id % 2 = 0 then '- ' else '• ' end) as response from documents)"


def _lists(spark, sf_dir) -> DataFrame:
    pairs = F.regexp_replace("text", r"(?<![^ \n])([^ \n]++ [^ \n]++) ", "$1\n")  # begun at a word's start only, as no later start in it does better
    cut = F.when(F.col("doc_id") % 3 == 0, pairs).otherwise(F.col("text"))
    mark = F.when(F.col("doc_id") % 2 == 0, "\n- ").otherwise("\n• ")
    documents = readers.balanced(a.table(spark, sf_dir, "documents"))  # whole texts are scored, which is worth a shuffle of one file
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.replace(cut, F.lit("\n"), mark).alias("response"))


@query("constraint_bullets", _twin("constraint_bullets", a.values(f.BULLETS, "id", "response"), _LISTS))
def constraint_bullets(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", s.penalties(F.col("response"), _constraints(bullet_count=F.lit(3)))["bullet_count"].alias("penalty"))


@query("constraint_bullet_words", _twin("constraint_bullet_words", a.values(f.BULLETS, "id", "response"), _LISTS))
def constraint_bullet_words(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", s.penalties(F.col("response"), _constraints(words_per_bullet=F.lit(2)))["words_per_bullet"].alias("penalty"))


@query("scoreable_text", _twin("scoreable_text", a.values(f.TEXTS, "id", "response", "reasoning"), "(select conv_id * 1000 + turn as id, case when role = 'assistant' then '  ' || text || chr(10) when turn % 4 = 0 then '   ' end as response, case when turn % 6 <> 0 then text || ' ' end as reasoning from conversations)"))
def scoreable_text(spark, sf_dir):
    c = a.table(spark, sf_dir, "conversations")
    response = F.when(F.col("role") == "assistant", F.concat(F.lit("  "), "text", F.lit("\n"))).when(F.col("turn") % 4 == 0, "   ")
    reasoning = F.when(F.col("turn") % 6 != 0, F.concat("text", F.lit(" ")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), s.scoreable(response, reasoning).alias("answer"))


_CODE = "(select doc_id as id, case doc_id % 4 when 0 then 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'done' when 1 then '```' || chr(10) || text || chr(10) || '```' when 2 then 'Here it is' || chr(10) || 'import os' || chr(10) || 'def g():' || chr(10) || text else text end as response from documents)"


@query("extract_code", _twin("extract_code", a.values([r[:2] for r in f.CODE], "id", "response"), _CODE))
def extract_code(spark, sf_dir):
    x = F.col("text")
    told = _case(F.col("doc_id") % 4, F.concat(F.lit("Sure:\n```python\n"), x, F.lit("\n```\ndone")), F.concat(F.lit("```\n"), x, F.lit("\n```")), F.concat(F.lit("Here it is\nimport os\ndef g():\n"), x), x)
    return a.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), s.code(told).alias("code"))


@query("tool_arguments", "select event_id as id, case event_id % 5 when 0 then 5.0 when 1 then 3.75 when 2 then 2.5 when 3 then 2.5 else 5.0 end::double as score from events")
def tool_arguments(spark, sf_dir):
    e = _events(spark, sf_dir)
    k, kind = F.col("k").cast("string"), F.col("event_id") % 5
    told = _case(kind, F.col("props"), F.concat(F.lit('{"k": '), k, F.lit(', "b": "x y"}')), F.col("props"), F.concat(F.lit("["), k, F.lit("]")), F.concat(F.lit('{"k": ['), k, F.lit(',true, null]}')))
    same = F.col("props")
    wanted = _case(kind, same, F.concat(F.lit('{"k": '), k, F.lit(', "b": "x  y"}')), F.concat(F.lit('{"k": '), (F.col("k") + 1).cast("string"), F.lit("}")), same, F.concat(F.lit('{"k": "['), k, F.lit(', True, None]"}')))
    call = F.struct(F.lit("c").alias("id"), F.lit("f").alias("function_name"), told.alias("function_args"))
    return e.select(F.col("event_id").cast("long").alias("id"), s.tool_trace(F.array(F.array(call)), F.lit("f"), s.json_fields(wanted), F.lit(""), F.lit(None).cast("array<string>")).alias("score"))


_WHOLE = """(select conv_id::varchar || '-' || turn as run_id, case when conv_id % 7 = 0 then '{broken' when conv_id % 5 = 0 then '{"choices": []}'
    else json_object('choices', [json_object('message', json_object(case when role = 'user' then 'reasoning_content' else 'content' end, text), 'finish_reason', 'stop')],
    'timings', json_object('prompt_n', turn, 'prompt_per_second', turn * 1.125, 'predicted_n', length(text), 'predicted_per_second', length(text) / 8.0))::varchar end as content from conversations)"""


@query("whole_responses", _twin("whole_responses", a.values(f.RESPONSES, "run_id", "content"), _WHOLE))
def whole_responses(spark, sf_dir):
    c = a.table(spark, sf_dir, "conversations")
    said = F.struct(F.when(F.col("role") != "user", F.col("text")).alias("content"), F.when(F.col("role") == "user", F.col("text")).alias("reasoning_content"))
    timings = F.struct(F.col("turn").alias("prompt_n"), (F.col("turn") * F.lit(1.125)).alias("prompt_per_second"), F.length("text").alias("predicted_n"), (F.length("text") / 8).alias("predicted_per_second"))
    body = F.to_json(F.struct(F.array(F.struct(said.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), timings.alias("timings")))
    content = F.when(F.col("conv_id") % 7 == 0, "{broken").when(F.col("conv_id") % 5 == 0, '{"choices": []}').otherwise(body)
    return sse.whole(c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"), content.alias("content")))
