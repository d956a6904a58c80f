"""Queries of streams: completions folded as they arrive, and lines out of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import quarantine
from ..streaming import completions, counts, framing
from . import adapters as a
from .registry import query
from .scoring_queries import _FOLDED

#: Batches that completion_fold's lines arrive in.
BATCHES = 4
_LATE = "run_id::bigint % 7 = 3"


@query(
    "completion_fold",
    f"""select run_id, turn, response_text, reasoning_text, first_at as ttft_s, gen_s, tokens as output_tokens_approx, finish_reason, n = 1 as single_chunk,
    case when run_id::bigint % 5 <> 0 then 'done' else 'time-out' end as ended, case when run_id::bigint % 5 <> 0 and {_LATE} then 1 else 0 end::bigint as n_late from {_FOLDED}""",
)
def completion_fold(spark, sf_dir):
    """The recorded streams as files that deal their lines out at random, with a line behind some end marks, folded batch by batch."""
    lines = a.recorded(spark, sf_dir).select("run_id", "turn", "seq", "arrival", "line")
    # a line behind the end mark, where there is one
    late = lines.where(F.col("line") == "data: [DONE]").where(F.pmod(F.col("run_id").cast("long"), F.lit(7)) == 3)
    late = late.withColumns({"seq": F.col("seq") + 1, "arrival": F.col("arrival") + 1, "line": F.lit('data: {"choices":[{"delta":{"content":" too late"}}]}')})
    path = counts.own_path(spark, "chunks")
    dealt = lines.unionByName(late).withColumn("turn", F.col("turn").cast("int"))
    files = max(1, -(-spark.sparkContext.defaultParallelism // BATCHES))  # of a batch, so that all cores write and read
    dealt.repartition(BATCHES * files, F.xxhash64("run_id", "turn", "seq")).write.json(path)
    last = spark.read.json(path, schema="arrival double").agg(F.max("arrival")).first()[0] or 0.0
    completions.flush_line(spark, last).coalesce(1).write.mode("append").json(path)
    out = completions.completions(completions.run_files(spark, path, files))
    return out.select("run_id", "turn", "response_text", "reasoning_text", "ttft_s", "gen_s", "output_tokens_approx", "finish_reason", "single_chunk", "ended", "n_late")


@query(
    "line_framing",
    """select run_id, turn, (i - 1)::bigint as line_no, line from (select run_id, turn, unnest(ls) as line, generate_subscripts(ls, 1) as i from (
    select conv_id::varchar as run_id, turn, string_split(coalesce(text, '') || case when conv_id % 4 <> 0 then chr(10) else '' end, chr(10)) as ps, ps[:-2] as ls from conversations))""",
)
def line_framing(spark, sf_dir):
    """Texts cut at places that have nothing to do with their lines, and put together again. Every fourth conversation ends within a line."""
    c = a.table(spark, sf_dir, "conversations")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 4 != 0, "\n").otherwise(""))
    width = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(60)) + 1).cast("int")
    rows = c.select(F.col("conv_id").cast("string").alias("run_id"), "turn", text.alias("text"), width.alias("w"))
    cuts = F.sequence(F.lit(0), F.floor(F.length("text") / F.col("w")).cast("int"))
    chunks = rows.select("run_id", "turn", "text", "w", F.explode(cuts).alias("seq")).select("run_id", "turn", F.col("seq").cast("long").alias("seq"), F.substring(F.col("text"), F.col("seq") * F.col("w") + 1, F.col("w")).alias("chunk"))
    return framing.lines(chunks, span=16)


# every line of a text is an event; some are planted as broken, by the line's place in its text
_PLANTED = """(select conv_id, turn, i - 1 as n, line, (conv_id + turn + i - 1) % 6 as kind from (select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from conversations))"""
_REASON = "case kind when 1 then 'not JSON' when 2 then 'no choice' when 3 then 'no data line' end"


@query(
    "quarantine_lines",
    f"""select 'dead' as part, {_REASON} as reason, conv_id || '/' || turn || '/' || n as place, case kind when 1 then 'data: {{broken ' || line when 2 then 'data: {{"choices":[]}}' else 'line ' || line end as raw, null::bigint as n
    from {_PLANTED} where kind in (1, 2, 3)
    union all select 'good', null, conv_id || '/' || turn, null, count(*) from {_PLANTED} where kind not in (1, 2, 3) group by conv_id, turn
    union all select 'count', name, null, null, n from (select count(*) as n_read, count(*) filter (kind not in (1, 2, 3)) as n_good, count(*) filter (kind = 1) as n_not_JSON, count(*) filter (kind = 2) as n_no_choice,
        count(*) filter (kind = 3) as n_no_data_line, 0 as n_other from {_PLANTED}) unpivot (n for name in (n_read, n_good, n_not_JSON, n_no_choice, n_no_data_line, n_other))""",
)
def quarantine_lines(spark, sf_dir):
    """Lines of texts as events, broken ones among them: every dead row with its reason and place, good rows by turn, and what was counted in the same pass."""
    c = a.table(spark, sf_dir, "conversations")
    each = c.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    kind = (F.col("conv_id") + F.col("turn") + F.col("n")) % 6
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(kind == 0, ": keep-alive").when(kind == 1, F.concat(F.lit("data: {broken "), "text")).when(kind == 2, 'data: {"choices":[]}').when(kind == 3, F.concat(F.lit("line "), "text")).when(kind == 4, "data: [DONE]").otherwise(event)
    rows = each.select("conv_id", "turn", "n", line.alias("line"))
    place = F.concat_ws("/", "conv_id", "turn", "n")
    out = quarantine.divide(rows, quarantine.event_reason(F.col("line")), place, F.col("line"), counts.own_path(spark, "quarantine"), ("not JSON", "no choice", "no data line"))
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    dead = out.dead.select(F.lit("dead").alias("part"), "reason", "place", "raw", none.alias("n"))
    good = out.good.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).select(F.lit("good").alias("part"), text.alias("reason"), F.concat_ws("/", "conv_id", "turn").alias("place"), text.alias("raw"), "n")
    told = spark.createDataFrame([("count", k, None, None, v) for k, v in out.counts.items()], "part string, reason string, place string, raw string, n long")
    return dead.unionByName(good).unionByName(told)
