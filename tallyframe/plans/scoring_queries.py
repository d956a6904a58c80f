"""Queries of the scorers, of validity and of the streamed completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..operators import runs
from ..sources import readers, schemas
from ..streaming import counts, sse
from . import adapters as a
from . import fixtures as f
from .registry import literal, query

KEYWORDS = ["the", "and", "of", "que", "nowhere"]
FORBIDDEN = ["pathetic", "worthless", "idiot"]
CHARS = [",", ";", "|"]
MARKS = ["All rights reserved", "token", "Of "]


def _response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.responses(spark, sf_dir).select("id", "response")


def _list(words) -> Column:
    return F.array(*map(F.lit, words))


def _constraints(**given) -> Column:
    """A constraint struct with these keys and all others missing."""
    fields = schemas.struct("c " + schemas.CONSTRAINTS)["c"].dataType.fields
    return F.struct(*(given.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in fields))


def _contains(text: str, word: str) -> str:
    return f"contains(lower({text}), lower({word}))"


def _count(text: str, words, want: bool = True) -> str:
    return f"len(list_filter({a.literal(words)}, lambda w: {'' if want else 'not '}{_contains(text, 'w')}))"


_CLEAN = a.strip(rf"regexp_replace({a.strip('response')}, '^`+|`+$', '', 'g')")
_EXACT = f"""case when clean = wanted then 5.0 when contains(lower(clean), lower(wanted))
    or contains(lower({a.strip(f"regexp_replace(clean, '{t.SPACE}+', ' ', 'g')")}), lower({a.strip(f"regexp_replace(wanted, '{t.SPACE}+', ' ', 'g')")})) then 3.0 else 0.0 end::double"""


@query(
    "score_exact",
    f"""with j as (select id, {_CLEAN} as clean, {a.strip('b.text')} as wanted from {a.RESPONSES} r join benchmark b on b.item_id = r.id % (select count(*) from benchmark))
    select id, {_EXACT} as score from j""",
)
def score_exact(spark, sf_dir):
    items = a.table(spark, sf_dir, "benchmark")
    n = F.broadcast(items.agg(F.count("*").alias("n")))  # one row
    rows = _response(spark, sf_dir).crossJoin(n).withColumn("item_id", F.col("id") % F.col("n"))
    return rows.join(items, "item_id").select("id", s.exact(F.col("response"), F.col("text")).alias("score"))


@literal("score_exact_cases", f"with j as (select id, {_CLEAN} as clean, {a.strip('expected')} as wanted from {a.values(f.EXACT, 'id', 'response', 'expected')}) select id::bigint as id, {_EXACT} as score from j")
def score_exact_cases(spark, sf_dir):
    return spark.createDataFrame(f.EXACT, "id long, response string, expected string").select("id", s.exact(F.col("response"), F.col("expected")).alias("score"))


@query("score_keywords", f"select id, round_even(5.0::double * {_count('response', KEYWORDS)} / {len(KEYWORDS)}, 1) as score from {a.RESPONSES}")
def score_keywords(spark, sf_dir):
    return _response(spark, sf_dir).select("id", s.keywords(F.col("response"), _list(KEYWORDS)).alias("score"))


@query("contain_join", f"select r.id, b.item_id from {a.RESPONSES} r join benchmark b on {_contains('r.response', 'b.text')}")
def contain_join(spark, sf_dir):
    return containment(_response(spark, sf_dir), a.table(spark, sf_dir, "benchmark"))


def containment(responses: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id) for every item text that a response holds, whatever the case.

    Of an item's words all but the first and the last stand in such a response as they are, between blanks. The longest
    of them is joined with the words of the responses, and only pairs that it brings together are looked at. Items
    without an inner word meet every response.
    """
    bodies = responses.select("id", F.lower("response").alias("body"))
    cut_up = F.split("part", " ")
    parts = items.select("item_id", F.lower("text").alias("part")).where("part is not null").withColumn("inner", F.slice(cut_up, 2, F.greatest(F.size(cut_up) - 2, F.lit(0))))
    longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    parts = parts.select("item_id", "part", longest["w"].alias("word"))
    told = F.coalesce(F.length("word"), F.lit(0)) > 0
    seen = bodies.select("id", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    near = seen.join(parts.where(told).select("item_id", "word"), "word").select("id", "item_id").distinct()
    found = near.join(parts.select("item_id", "part"), "item_id").join(bodies, "id").where(F.contains("body", "part"))
    rest = bodies.join(parts.where(~told), F.contains("body", "part"))
    return found.select("id", "item_id").unionByName(rest.select("id", "item_id"))


def _penalty(name: str, given: Callable[[], Column], sql: str):
    key = name.removeprefix("constraint_")

    @query(name, f"select id, {sql}::double as penalty from {a.RESPONSES}")
    def run(spark, sf_dir):
        field = {"required": "required_words", "bullets": "bullet_count", "bullet_words": "words_per_bullet", "lines": "line_count", "forbidden": "forbidden_words"}.get(key, key)
        return _response(spark, sf_dir).select("id", s.penalties(F.col("response"), _constraints(**{field: given()}))[field].alias("penalty"))

    return run


_penalty("constraint_word_count", lambda: F.lit(60), f"case when {a.words('response')} = 60 then 0 else 2 end")
_penalty("constraint_required", lambda: _list(KEYWORDS), _count("response", KEYWORDS, False))
_penalty("constraint_forbidden_chars", lambda: _list(CHARS), f"len(list_filter({a.literal(CHARS)}, lambda c: contains(response, c)))")
_penalty("constraint_lines", lambda: F.lit(5), f"case when len(list_filter({a.lines('response')}, lambda l: {a.strip('l')} <> '')) = 5 then 0 else 2 end")
_penalty("constraint_word_range", lambda: F.array(F.lit(50), F.lit(300)), f"case when {a.words('response')} between 50 and 300 then 0 else 2 end")
_penalty("constraint_forbidden", lambda: _list(FORBIDDEN), _count("response", FORBIDDEN))
_penalty("constraint_required_elements", lambda: _list(MARKS), _count("response", MARKS, False))
_penalty("constraint_forbidden_elements", lambda: _list(MARKS), _count("response", MARKS))


def _bullet_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(f.BULLETS, "id long, response string")


_V_BULLETS = a.values(f.BULLETS, "id", "response")
_BULLET = f"regexp_replace({a.strip('b')}, '^[-*• ]+', '')"
_WRONG = f"len(list_filter({a.bullets('response')}, lambda b: {a.words(_BULLET)} <> 2))"


@literal("constraint_bullets", f"select id::bigint as id, case when len({a.bullets('response')}) = 3 then 0 else 1 end::double as penalty from {_V_BULLETS}")
def constraint_bullets(spark, sf_dir):
    return _bullet_rows(spark).select("id", s.penalties(F.col("response"), _constraints(bullet_count=F.lit(3)))["bullet_count"].alias("penalty"))


@literal("constraint_bullet_words", f"select id::bigint as id, (0.5 * {_WRONG})::double as penalty from {_V_BULLETS}")
def constraint_bullet_words(spark, sf_dir):
    return _bullet_rows(spark).select("id", s.penalties(F.col("response"), _constraints(words_per_bullet=F.lit(2)))["words_per_bullet"].alias("penalty"))


@query(
    "score_constraint",
    f"""select id, greatest(0, 5 - case when {a.words('response')} between 50 and 300 then 0 else 2 end - {_count('response', KEYWORDS[:2], False)} - {_count('response', FORBIDDEN)}
    - len(list_filter({a.literal(CHARS)}, lambda c: contains(response, c))))::double as score from {a.RESPONSES}""",
)
def score_constraint(spark, sf_dir):
    c = _constraints(word_range=F.array(F.lit(50), F.lit(300)), required_words=_list(KEYWORDS[:2]), forbidden_words=_list(FORBIDDEN), forbidden_chars=_list(CHARS))
    return _response(spark, sf_dir).select("id", s.constraints(F.col("response"), c).alias("score"))


@literal("scoreable_text", f"select id::bigint as id, coalesce(nullif({a.strip('response')}, ''), {a.strip('reasoning')}, '') as answer from {a.values(f.TEXTS, 'id', 'response', 'reasoning')}")
def scoreable_text(spark, sf_dir):
    return spark.createDataFrame(f.TEXTS, "id long, response string, reasoning string").select("id", s.scoreable(F.col("response"), F.col("reasoning")).alias("answer"))


_INVALID = f"(finish_reason is not distinct from 'error' or {a.strip('response')} = '' or (finish_reason is not distinct from 'length' and category is distinct from 'creative'))"


@query("validity", f"select id, {_INVALID} as invalid from {a.RESPONSES}")
def validity(spark, sf_dir):
    answer = s.scoreable(F.col("response"), F.lit(""))
    return a.responses(spark, sf_dir).select("id", s.is_invalid(answer, F.col("finish_reason"), F.col("category")).alias("invalid"))


_WAYS = ["exact", "judge_keyword", "constraint_check", "judge", None, "judge_constraint", "unit_tests", "tool_trace_exact"]


@query(
    "score_router",
    f"""with r as (select *, {a.strip('response')} as answer, {a.literal(_WAYS)}[id % 8 + 1] as way from {a.RESPONSES}),
    k as (select *, round_even(5.0::double * {_count('answer', KEYWORDS)} / {len(KEYWORDS)}, 1) as words from r)
    select id, case when {_INVALID} then null when way = 'exact' then case when answer = 'The' then 5.0 when {_contains('answer', "'The'")} then 3.0 else 0.0 end
      when way = 'judge_keyword' then words when way = 'unit_tests' then case when id % 16 = 6 then 5.0 else 1.0 end
      when way = 'tool_trace_exact' then least(5, (case when id % 3 = 1 then 5.0 else 2.5 end + words) / 2)
      when way in ('constraint_check', 'judge_constraint') then case when {a.words('answer')} between 50 and 300 then 5.0 else 3.0 end end::double as score,
    case when {_INVALID} then 'invalid' when way = 'exact' then 'exact' when way = 'judge_keyword' then 'keyword' when way = 'unit_tests' then 'unit_test' when way = 'tool_trace_exact' then 'tool_trace'
      when way in ('constraint_check', 'judge_constraint') then 'constraint' else 'needs_judge' end as score_type
    from k""",
)
def score_router(spark, sf_dir):
    rows = a.responses(spark, sf_dir).withColumn("answer", s.scoreable(F.col("response"), F.lit("")))
    answer = F.col("answer")  # a column of its own, so that it is computed once a row
    invalid = s.is_invalid(answer, F.col("finish_reason"), F.col("category"))
    case = {
        "scoring": F.element_at(_list(_WAYS), (F.col("id") % 8 + 1).cast("int")), "expected": F.lit("The"), "expected_keywords": _list(KEYWORDS), "test_code": F.lit("assert True"),
        "constraints": _constraints(word_range=F.array(F.lit(50), F.lit(300))), "expected_tool_call": F.lit("f"), "expected_args_contain": F.create_map(F.lit("k"), F.lit("1")),
    }
    call = F.struct(F.lit("c").alias("id"), F.lit("f").alias("function_name"), F.format_string('{"k": %d}', F.col("id") % 3).alias("function_args"))
    unit = F.when(F.col("id") % 16 == 6, 5.0).otherwise(1.0)
    return rows.select("id", s.route(answer, invalid, case, F.array(F.array(call)), unit).alias("r")).select("id", "r.score", "r.score_type")


@literal(
    "extract_code",
    f"""with c as (select *, string_split(response, chr(10)) as ls from {a.values([r[:2] for r in f.CODE], 'id', 'response')}),
    p as (select *, list_position(list_transform(ls, lambda l: regexp_matches({a.strip('l')}, '^(def |class )')), true) as first from c)
    select id::bigint as id, case when regexp_matches(response, '{s.FENCED}') then regexp_extract(response, '{s.FENCED}', 1)
      when first > 0 then array_to_string(ls[first:], chr(10)) else response end as code from p""",
)
def extract_code(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in f.CODE], "id long, response string").select("id", s.code(F.col("response")).alias("code"))


@query(
    "tool_trace",
    """with e as (select event_id as id, event_type as name, json_extract_string(props, '$.k') as k from events),
    c as (select id, case when name = 'click' then 2.5 + 2.5 * (case when k = '7' then 1 else 0 end) else 0.0 end as called, case when contains(name, 'i') then 2.5 else 0.0 end as kw from e)
    select id, least(5.0, case when called > 0 then (called + kw) / 2 else kw end)::double as score from c""",
)
def tool_trace(spark, sf_dir):
    e = readers.balanced(a.table(spark, sf_dir, "events"))
    call = F.struct(F.lit("c").alias("id"), F.col("event_type").alias("function_name"), F.col("props").alias("function_args"))
    trace = F.array(F.array().cast(f"array<{schemas.CALL}>"), F.array(call))
    args = F.create_map(F.lit("k"), F.lit("7"))
    return e.select(F.col("event_id").alias("id"), s.tool_trace(trace, F.lit("click"), args, F.col("event_type"), _list(["i", "absent"])).alias("score"))


@literal("tool_arguments", f"select id::bigint as id, score::double as score from {a.values(f.ARGUMENTS, 'id', 'args', 'expected', 'score')}")
def tool_arguments(spark, sf_dir):
    rows = spark.createDataFrame([r[:3] for r in f.ARGUMENTS], "id long, args string, expected string")
    call = F.struct(F.lit("c").alias("id"), F.lit("f").alias("function_name"), F.col("args").alias("function_args"))
    return rows.select("id", s.tool_trace(F.array(F.array(call)), F.lit("f"), s.json_fields(F.col("expected")), F.lit(""), F.lit(None).cast("array<string>")).alias("score"))


@query(
    "tool_lookup",
    """with c as (select conv_id, turn, text, max(turn) over (partition by conv_id) as last from conversations where (conv_id + turn) % 3 = 0)
    select c.conv_id::varchar as case_id, c.turn::int as turn, case when c.turn = c.last then '{}' else coalesce(left(c.text, 20), '') end as answer from c""",
)
def tool_lookup(spark, sf_dir):
    # each conversation's files are what it says in turns that call a tool, but for the last of them
    merged = sse.merge_calls(sse.call_deltas(sse.parse(a.recorded(spark, sf_dir)))).select(F.col("run_id").alias("case_id"), "turn", F.inline("calls")).drop("id")
    c = a.table(spark, sf_dir, "conversations").where((F.col("conv_id") + F.col("turn")) % 3 == 0)
    kept = c.select(F.col("conv_id").cast("string").alias("case_id"), "turn", F.concat(F.lit("read_file:"), F.col("turn").cast("string"), F.lit(".txt")).alias("k"), F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("v"))
    listed = kept.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k", "v"))).alias("es"))
    files = listed.select("case_id", F.map_from_entries(F.transform(F.slice("es", F.lit(1), F.size("es") - 1), lambda e: F.struct(e["k"], e["v"]))).alias("tool_responses"))
    return sse.tool_answers(merged, files).select("case_id", "turn", "answer")


@query("tokens_approx", f"select id, case when length(response) > 0 then greatest(length(response) // 4, 1) else 0 end::int as tokens from {a.RESPONSES}")
def tokens_approx(spark, sf_dir):
    return _response(spark, sf_dir).select("id", t.tokens(F.col("response")).alias("tokens"))


_TURNS = "(select conv_id, turn, length(text) as chars, case when length(text) > 0 then greatest(length(text) // 4, 1) else 0 end as tokens, (turn % 4) * 0.5::double as gen_s from conversations)"


@query("throughput", f"select conv_id, turn, round_even(case when tokens > 0 then tokens / greatest(gen_s, 1e-9) else 0 end, 6) as tok_per_s, gen_s <= 1e-9 as single_chunk from {_TURNS}")
def throughput(spark, sf_dir):
    c = a.table(spark, sf_dir, "conversations").withColumn("gen_s", (F.col("turn") % 4) * F.lit(0.5))
    return c.select("conv_id", "turn", F.bround(t.rate(t.tokens(F.col("text")), F.col("gen_s")), 6).alias("tok_per_s"), (F.col("gen_s") <= sse.LEAST_S).alias("single_chunk"))


@query(
    "real_throughput",
    f"""select r.model_label, count(*) as n, round_even(avg(length(t.response) / 4.0 / r.gen_s), 6) as mean_of_ratios, round_even(sum(length(t.response)) / 4.0 / sum(r.gen_s), 6) as ratio_of_sums
    from {a.TURNS} r join {a.TURNS} t using (bench_run_id, run_id) where r.gen_s > 0 group by 1""",
)
def real_throughput(spark, sf_dir):
    turns = a.turns(spark, sf_dir)
    return runs.real_throughput(turns.select("bench_run_id", "run_id", "response", "reasoning"), turns.select("bench_run_id", "run_id", "model_label", "gen_s"))


@literal(
    "whole_responses",
    f"""with r as (select run_id, content::json as j from {a.values(f.RESPONSES, 'run_id', 'content')} where json_valid(content)), c as (select run_id, j, json_extract(j, '$.choices[0]') as c from r)
    select run_id, {a.strip("coalesce(json_extract_string(c, '$.message.content'), '')")} as response_text, coalesce(json_extract_string(c, '$.message.reasoning_content'), '') as reasoning_text, json_extract_string(c, '$.finish_reason') as finish_reason,
    coalesce(json_extract(j, '$.timings.prompt_n')::int, 0) as prompt_n, round_even(coalesce(json_extract(j, '$.timings.prompt_per_second')::double, 0), 2) as prompt_per_second,
    coalesce(json_extract(j, '$.timings.predicted_n')::int, 0) as predicted_n, round_even(coalesce(json_extract(j, '$.timings.predicted_per_second')::double, 0), 2) as predicted_per_second from c where c is not null""",
)
def whole_responses(spark, sf_dir):
    return sse.whole(spark.createDataFrame(f.RESPONSES, "run_id string, content string"))


_PARSED = f"""(select run_id, turn::int as turn, seq::bigint as seq, arrival::double as arrival, nullif(json_extract_string(j, '$.choices[0].delta.content'), '') as content,
    coalesce(nullif(json_extract_string(j, '$.choices[0].delta.reasoning_content'), ''), nullif(json_extract_string(j, '$.choices[0].delta.reasoning'), '')) as reasoning,
    json_extract(j, '$.choices[0].delta.tool_calls') as calls, nullif(json_extract_string(j, '$.choices[0].finish_reason'), '') as finish_reason
    from (select *, case when json_valid(body) then body end as j from (select *, substr({a.strip('line')}, 7) as body from {a.RECORDED} where starts_with({a.strip('line')}, 'data: '))) where json_extract(j, '$.choices[0]') is not null)"""


@query("sse_parse", f"select run_id, turn, seq, content, reasoning, finish_reason, coalesce(json_array_length(calls), 0)::int as n_calls from {_PARSED}")
def sse_parse(spark, sf_dir):
    return sse.parse(a.recorded(spark, sf_dir)).select("run_id", "turn", "seq", "content", "reasoning", "finish_reason", F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).alias("n_calls"))


_FOLD = f"""(select run_id, turn, {a.strip("coalesce(string_agg(content, '' order by seq), '')")} as response_text, coalesce(string_agg(reasoning, '' order by seq), '') as reasoning_text,
    min(arrival) filter (content is not null or reasoning is not null or calls is not null) as first_at, max(arrival) filter (content is not null or reasoning is not null or calls is not null) as last_at,
    count(*) filter (content is not null or reasoning is not null or calls is not null) as n, arg_max(finish_reason, seq) filter (finish_reason is not null) as finish_reason from {_PARSED} group by run_id, turn)"""
_FOLDED = f"""(select *, greatest(coalesce(last_at - first_at, 0), 1e-9)::double as gen_s, case when length(response_text || reasoning_text) > 0 then greatest(length(response_text || reasoning_text) // 4, 1) else 0 end::int as tokens from {_FOLD})"""


@query(
    "stream_fold",
    f"""select run_id, turn, response_text, reasoning_text, first_at as ttft_s, gen_s, tokens as output_tokens_approx,
    round_even(case when tokens > 0 then tokens / gen_s else 0 end, 6) as tok_per_s, n = 1 as single_chunk, finish_reason from {_FOLDED}""",
)
def stream_fold(spark, sf_dir):
    return sse.fold(sse.parse(a.recorded(spark, sf_dir))).withColumn("tok_per_s", F.bround("tok_per_s", 6))


_DELTAS = f"""(select run_id, turn, seq * 1000000 + i - 1 as seq, coalesce(json_extract(c, '$.index')::int, 0) as idx, nullif(json_extract_string(c, '$.id'), '') as id, json_extract_string(c, '$.function.name') as name,
    json_extract_string(c, '$.function.arguments') as args from (select *, unnest(json_extract(calls, '$[*]')) as c, generate_subscripts(json_extract(calls, '$[*]'), 1) as i from {_PARSED} where calls is not null))"""
_MERGED = f"""(select run_id, turn, idx, min(seq) as first, arg_max(id, seq) filter (id is not null) as id, coalesce(string_agg(name, '' order by seq), '') as name, coalesce(string_agg(args, '' order by seq), '') as args from {_DELTAS} group by all)"""


@query("merge_tool_calls", f"select run_id, turn, (row_number() over (partition by run_id, turn order by first) - 1)::int as at, id, name as function_name, args as function_args from {_MERGED}")
def merge_tool_calls(spark, sf_dir):
    merged = sse.merge_calls(sse.call_deltas(sse.parse(a.recorded(spark, sf_dir))))
    return merged.select("run_id", "turn", F.posexplode("calls").alias("at", "c")).select("run_id", "turn", "at", "c.id", "c.function_name", "c.function_args")


@query(
    "turn_rollup",
    f"""with n as (select run_id, turn, count(*) as calls from {_MERGED} group by all), f as (select f.*, coalesce(calls, 0) as calls from {_FOLDED} f left join n using (run_id, turn)),
    o as (select *, row_number() over w as k, coalesce(max(calls = 0 or finish_reason is distinct from 'tool_calls') over (w rows between unbounded preceding and 1 preceding), false) as over_ from f window w as (partition by run_id order by turn))
    select run_id, arg_max(response_text, turn) as response_text, arg_max(finish_reason, turn) as finish_reason, arg_min(first_at, turn) as ttft_s, sum(gen_s)::double as gen_s, sum(tokens)::bigint as output_tokens_approx, count(*) as turns,
    sum(calls)::bigint as n_calls, round_even(sum(tokens) / sum(gen_s), 6) as tok_per_s from o where not over_ and k <= 4 group by run_id""",
)
def turn_rollup(spark, sf_dir):
    parsed = sse.parse(a.recorded(spark, sf_dir))
    turns = sse.fold(parsed).join(sse.merge_calls(sse.call_deltas(parsed)), ["run_id", "turn"], "left")
    out = sse.roll_up(turns)
    return out.select("run_id", "response_text", "finish_reason", "ttft_s", "gen_s", "output_tokens_approx", "turns", F.size(F.flatten("tool_calls_trace")).cast("long").alias("n_calls"), F.bround("tok_per_s", 6).alias("tok_per_s"))


@query("ordered_concat", "select conv_id, string_agg(text, '' order by turn) as text, count(*) as turns from conversations group by conv_id")
def ordered_concat(spark, sf_dir):
    c = a.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.expr("listagg(text, '') within group (order by turn)").alias("text"), F.count("*").alias("turns"))


@query("stream_counts", "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, round_even(avg(value), 6) as mean_value from events group by 1, 2")
def stream_counts(spark, sf_dir):
    events = a.table(spark, sf_dir, "events")
    # a file stream takes a folder, of which the pattern picks the one table
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    out = counts.run_to_end(counts.counts(stream), counts.own_path(spark, "counts"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.bround("mean_value", 6).alias("mean_value"))
