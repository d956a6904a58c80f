"""Views of the test tables as evaluation data, in Spark and in SQL, and literal rows for shapes that the tables lack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NO_SPACE, SPACE
from ..sources import readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log: model_label, prompt_id, seq, score, arrival, args, valid. Every seventh value of k is an invalid run."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("model_label"), F.col("user_id").alias("prompt_id"), F.col("event_id").alias("seq"), F.col("value").alias("score"),
        F.col("ts").alias("arrival"), F.col("props").alias("args"), (k % 7 != 0).alias("valid"),
    )


RUNS = """(select event_type as model_label, user_id as prompt_id, event_id as seq, value as score, ts as arrival, props as args,
    cast(json_extract_string(props, '$.k') as int) % 7 <> 0 as valid from events)"""

BEST = f"""(select * from (select *, row_number() over (partition by prompt_id, model_label order by score desc nulls last, seq) as rn from {RUNS}) where rn = 1)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as responses: id, model_label, category, response, finish_reason (cut off for every ninth)."""
    d = readers.balanced(table(spark, sf_dir, "documents"))  # whole texts are scored, which is worth a shuffle of one file
    reason = F.when(F.col("doc_id") % 9 == 0, "length").when(F.col("doc_id") % 31 == 0, "error").when(F.col("doc_id") % 2 == 0, "stop")
    category = F.when(F.col("lang") == "fr", "creative").otherwise(F.col("lang"))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("model_label"), category.alias("category"), F.col("text").alias("response"), reason.alias("finish_reason"))


RESPONSES = """(select doc_id as id, source as model_label, case when lang = 'fr' then 'creative' else lang end as category, text as response,
    case when doc_id % 9 = 0 then 'length' when doc_id % 31 = 0 then 'error' when doc_id % 2 = 0 then 'stop' end as finish_reason from documents)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as scored runs: model_label, category, valid, score on 0 to 5."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("source").alias("model_label"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("valid"), (F.lit(5.0) * (1 - F.col("toxic"))).alias("score"))


GRADED = "(select source as model_label, lang as category, quality = 1 as valid, 5.0 * (1 - toxic) as score from documents join labels using (doc_id))"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcripts with their times: bench_run_id, run_id, model_label, response, reasoning, gen_s, total_s."""
    c = table(spark, sf_dir, "conversations")
    gen = (F.col("turn") % 4) * F.lit(0.5)
    return c.select(
        F.col("conv_id").cast("string").alias("bench_run_id"), F.col("turn").cast("string").alias("run_id"), F.col("role").alias("model_label"), F.col("text").alias("response"),
        F.lit(None).cast("string").alias("reasoning"), gen.alias("gen_s"), (gen + F.col("conv_id") % 7 * F.lit(0.25)).alias("total_s"),
    )


TURNS = "(select conv_id::varchar as bench_run_id, turn::varchar as run_id, role as model_label, text as response, (turn % 4) * 0.5::double as gen_s, ((turn % 4) * 0.5 + conv_id % 7 * 0.25)::double as total_s from conversations)"


#: Characters of a text that go into one event.
PIECE = 40


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as recorded streams, an event for each piece of a text: run_id, turn, seq (from 0, without gaps), arrival, line.

    What users say is reasoning, the rest content. Every third turn calls a tool, its arguments in two events; each turn
    begins with a line that says nothing, or with a broken one, and ends with an end mark, but every fifth conversation.
    """
    talks = readers.balanced(table(spark, sf_dir, "conversations"))  # a text becomes many lines, which is worth a shuffle of one file
    c = talks.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda *fields: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(*fields)).alias("choices"))))
    delta = lambda name, x: event(F.struct(x.alias(name)).alias("delta"))
    cuts = F.filter(F.sequence(F.lit(0), F.ceil(F.length("text") / PIECE).cast("int")), lambda k: k * PIECE < F.length("text"))
    said = F.transform(cuts, lambda k: (lambda x: F.when(F.col("role") == "user", delta("reasoning_content", x)).otherwise(delta("content", x)))(F.substring(F.col("text"), k * PIECE + 1, F.lit(PIECE))))
    function = lambda **x: F.struct(*(v.alias(k) for k, v in x.items())).alias("function")
    named = function(name=F.lit("read_file"), arguments=F.lit('{"path": "'))
    first = delta("tool_calls", F.array(F.struct(F.lit(0).alias("index"), F.concat(F.lit("c"), "turn").alias("id"), named)))
    second = delta("tool_calls", F.array(F.struct(F.lit(0).alias("index"), function(arguments=F.concat("turn", F.lit('.txt"}'))))))
    third = (F.col("conv_id") + F.col("turn")) % 3 == 0
    end = event(F.struct(F.lit("").alias("content")).alias("delta"), F.when(third, "tool_calls").otherwise("stop").alias("finish_reason"))
    nothing = F.array().cast("array<string>")
    opening = F.array(F.when(F.col("conv_id") % 11 == 0, "data: {broken").otherwise(": keep-alive"))
    whole = F.concat(opening, said, F.when(third, F.array(first, second)).otherwise(nothing), F.array(end), F.when(F.col("conv_id") % 5 != 0, F.array(F.lit("data: [DONE]"))).otherwise(nothing))
    rows = c.select(F.col("conv_id").cast("string").alias("run_id"), "turn", F.posexplode(whole).alias("seq", "line"))
    return rows.select("run_id", "turn", F.col("seq").cast("long").alias("seq"), (F.col("turn") * 100 + F.col("seq") * 0.25).cast("double").alias("arrival"), "line")


RECORDED = f"""(select run_id, turn, unnest(ls) as line, (generate_subscripts(ls, 1) - 1)::bigint as seq, (turn * 100 + seq * 0.25)::double as arrival from (
    select conv_id::varchar as run_id, turn::int as turn, [case when conv_id % 11 = 0 then 'data: {{broken' else ': keep-alive' end]
    || list_transform(list_filter(range(0, length(x) // {PIECE} + 1), lambda k: k * {PIECE} < length(x)), lambda k: 'data: ' || case when role = 'user'
        then json_object('choices', [json_object('delta', json_object('reasoning_content', substr(x, (k * {PIECE} + 1)::bigint, {PIECE})))])::varchar else json_object('choices', [json_object('delta', json_object('content', substr(x, (k * {PIECE} + 1)::bigint, {PIECE})))])::varchar end)
    || case when (conv_id + turn) % 3 = 0 then ['data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"id":"c' || turn || '","function":{{"name":"read_file","arguments":"{{\\"path\\": \\""}}}}]}}}}]}}',
        'data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"function":{{"arguments":"' || turn || '.txt\\"}}"}}}}]}}}}]}}'] else []::varchar[] end
    || ['data: {{"choices":[{{"delta":{{"content":""}},"finish_reason":"' || case when (conv_id + turn) % 3 = 0 then 'tool_calls' else 'stop' end || '"}}]}}']
    || case when conv_id % 5 <> 0 then ['data: [DONE]'] else []::varchar[] end as ls from (select *, coalesce(text, '') as x from conversations)))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a large run log. Its keys aren't unique, so all its columns order it."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_suppkey").alias("model_label"), F.col("l_linenumber").alias("repeat"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("framework"),
    )


def literal(v) -> str:
    """A value as SQL text that Spark and DuckDB read alike."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: Sequence[Sequence], *columns: str) -> str:
    """A DuckDB table of literal rows."""
    return f"(select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(columns)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NO_SPACE}+'))"


def lines(x: str) -> str:
    return f"string_split({strip(x)}, chr(10))"


def bullets(x: str) -> str:
    return rf"list_filter({lines(x)}, lambda b: regexp_matches({strip('b')}, '^[-*•]'))"


def mean(x: str) -> str:
    return f"round_even(avg({x}), 6)"
