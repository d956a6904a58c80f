"""Streamed completions: lines of server-sent events to one row for each completion, and to one for each run of several turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.rounding import half_even
from ..sources import schemas

#: The least time that a completion is taken to last.
LEAST_S = 1e-9
MAX_TURNS = 4


DONE = "data: [DONE]"


def read(lines: DataFrame) -> DataFrame:
    """Every line with what it says: its own columns but the text, done (it is the end mark), event (it is well-formed and has a choice), content, reasoning, tool_calls, finish_reason. Works on a stream too."""
    line = t.strip(F.col("line"))
    body = F.when(F.startswith(line, F.lit("data: ")), F.substr(line, F.lit(7)))
    whole = lines.withColumn("__e", F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schemas.struct("e " + schemas.EVENT)["e"].dataType)))
    choice = F.try_element_at("__e.choices", F.lit(1))
    some = lambda c: F.nullif(c, F.lit(""))
    return whole.select(
        *(c for c in lines.columns if c != "line"),
        F.coalesce(line == DONE, F.lit(False)).alias("done"),
        choice.isNotNull().alias("event"),
        some(choice["delta"]["content"]).alias("content"),
        F.coalesce(some(choice["delta"]["reasoning_content"]), some(choice["delta"]["reasoning"])).alias("reasoning"),
        F.nullif(choice["delta"]["tool_calls"], F.array().cast(f"array<{schemas.DELTA_CALL}>")).alias("tool_calls"),
        some(choice["finish_reason"]).alias("finish_reason"),
    )


def parse(lines: DataFrame) -> DataFrame:
    """Deltas of well-formed data lines: run_id, turn, seq, arrival, content, reasoning, tool_calls, finish_reason. Works on a stream too."""
    keep = [c for c in ("run_id", "turn", "seq", "arrival") if c in lines.columns]
    return read(lines.select(*keep, "line")).where("event and not done").drop("event", "done")


def merge_calls(deltas: DataFrame, keys: tuple[str, ...] = ("run_id", "turn")) -> DataFrame:
    """Call deltas (keys, seq, index, id, name, arguments) to a list of calls for each key: last id, joined names and arguments, in order of first sight."""
    by = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", F.col(c).alias("x"))))), lambda s: s["x"]), "")
    merged = deltas.groupBy(*keys, "index").agg(
        F.min("seq").alias("first"), F.max_by(F.nullif("id", F.lit("")), F.when(F.coalesce("id", F.lit("")) != "", F.col("seq"))).alias("id"), by("name").alias("function_name"), by("arguments").alias("function_args")
    )
    call = F.struct("id", "function_name", "function_args")
    listed = F.sort_array(F.collect_list(F.struct("first", call.alias("call"))))
    return merged.groupBy(*keys).agg(F.transform(listed, lambda x: x["call"]).alias("calls"))


def call_deltas(parsed: DataFrame) -> DataFrame:
    """One row for each call delta; seq keeps their order within an event too."""
    one = parsed.where("tool_calls is not null").select("run_id", "turn", "seq", F.posexplode("tool_calls").alias("at", "c"))
    return one.select("run_id", "turn", F.struct("seq", "at").alias("seq"), F.coalesce("c.index", F.lit(0)).alias("index"), F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def fold(parsed: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """A row for each completion. starts: (run_id, turn, started); without it the clock starts at 0."""
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("x"))))), lambda s: s["x"]), "")
    payload = F.col("content").isNotNull() | F.col("reasoning").isNotNull() | F.col("tool_calls").isNotNull()
    at = F.when(payload, F.col("arrival"))
    out = parsed.groupBy("run_id", "turn").agg(
        t.strip(joined("content")).alias("response_text"), joined("reasoning").alias("reasoning_text"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.count_if(payload).alias("n_payloads"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
    )
    out = out.join(starts, ["run_id", "turn"], "left") if starts is not None else out.withColumn("started", F.lit(0.0))
    return timed(out)


def timed(folded: DataFrame, *more: str) -> DataFrame:
    """Times, tokens and rate of completions: run_id, turn, response_text, reasoning_text, first_at, last_at, n_payloads, finish_reason, started. more: further columns to keep."""
    gen = F.greatest(F.coalesce(F.col("last_at") - F.col("first_at"), F.lit(0.0)), F.lit(LEAST_S))
    tokens = t.tokens(F.col("response_text"), F.col("reasoning_text"))
    return folded.select(
        "run_id", "turn", "response_text", "reasoning_text", (F.col("first_at") - F.col("started")).alias("ttft_s"), gen.alias("gen_s"), tokens.alias("output_tokens_approx"),
        t.rate(tokens, gen).alias("tok_per_s"), (F.col("n_payloads") == 1).alias("single_chunk"), "finish_reason", *more,
    )


def roll_up(turns: DataFrame) -> DataFrame:
    """Runs of up to MAX_TURNS turns as one row each. turns: run_id, turn, texts and times of fold(), calls.

    A run ends with its first turn that calls no tool or doesn't stop for one; later rows are left out.
    """
    ends = (F.coalesce(F.size("calls"), F.lit(0)) <= 0) | ~F.col("finish_reason").eqNullSafe("tool_calls")
    before = Window.partitionBy("run_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    live = turns.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy("turn"))).withColumn("__over", F.coalesce(F.max(ends).over(before), F.lit(False)))
    live = live.where(~F.col("__over") & (F.col("__n") <= MAX_TURNS))
    out = live.groupBy("run_id").agg(
        F.max_by("response_text", "turn").alias("response_text"), F.max_by("reasoning_text", "turn").alias("reasoning_text"), F.max_by("finish_reason", "turn").alias("finish_reason"),
        F.min_by("ttft_s", "turn").alias("ttft_s"), F.sum("gen_s").alias("gen_s"), F.sum("output_tokens_approx").alias("output_tokens_approx"), F.count("*").alias("turns"),
        F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("calls", F.array().cast(f"array<{schemas.CALL}>")).alias("c")))), lambda x: x["c"]).alias("tool_calls_trace"),
    )
    return out.withColumn("tok_per_s", F.when(F.col("gen_s") > 0, F.col("output_tokens_approx") / F.col("gen_s")).otherwise(0.0))


def whole(responses: DataFrame) -> DataFrame:
    """Responses that came in one piece (run_id, content: JSON): texts, finish_reason and the server's own timings, rates to 2 places. What doesn't parse or has no choice is passed over."""
    parsed = responses.where(F.try_parse_json("content").isNotNull()).withColumn("r", F.from_json("content", schemas.struct("r " + schemas.RESPONSE)["r"].dataType))
    choice = F.try_element_at("r.choices", F.lit(1))
    n = lambda c: F.coalesce(F.col(f"r.timings.{c}"), F.lit(0)).alias(c)
    rate = lambda c: half_even(F.coalesce(F.col(f"r.timings.{c}"), F.lit(0.0)), 2).alias(c)
    texts = (t.strip(F.coalesce(choice["message"]["content"], F.lit(""))).alias("response_text"), F.coalesce(choice["message"]["reasoning_content"], F.lit("")).alias("reasoning_text"))
    return parsed.where(choice.isNotNull()).select("run_id", *texts, choice["finish_reason"].alias("finish_reason"), n("prompt_n"), rate("prompt_per_second"), n("predicted_n"), rate("predicted_per_second"))


def tool_answers(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """The mock answer to each call: calls (.., case_id, function_name, function_args), responses (case_id, tool_responses map). read_file is told apart by path."""
    path = F.try_element_at(F.from_json("function_args", "map<string, string>"), F.lit("path"))
    key = F.when((F.col("function_name") == "read_file") & path.isNotNull(), F.concat_ws(":", F.col("function_name"), path)).otherwise(F.col("function_name"))
    return calls.join(responses, "case_id", "left").withColumn("answer", F.coalesce(F.try_element_at("tool_responses", key), F.lit("{}"))).drop("tool_responses")
