"""Streams: literal lines against the twins, line framing, and completions folded as they arrive."""

import random
from datetime import datetime, timezone

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyframe.plans import adapters as a
from tallyframe.plans import catalogue, fixtures
from tallyframe.plans import scoring_queries as q
from tallyframe.sources import schemas
from tallyframe.streaming import completions, counts, framing, sse


@pytest.mark.parametrize("name", ["sse_parse", "stream_fold", "merge_tool_calls", "turn_rollup"])
def test_literal_lines_and_twin_agree(spark, name, monkeypatch):
    monkeypatch.setattr(a, "recorded", lambda spark, sf_dir: spark.createDataFrame(fixtures.LINES, schemas.CHUNK))
    got = catalogue.queries()[name](spark, "nowhere")
    sql = catalogue.oracle_sql()[name].replace(a.RECORDED, a.values(fixtures.LINES, "run_id", "turn", "seq", "arrival", "line"))
    assert "conversations" not in sql
    want = duckdb.sql(sql)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, rows)) and rows


def test_tool_answers(spark):
    calls = spark.createDataFrame(fixtures.CALLS, "id long, case_id string, function_name string, function_args string")
    responses = spark.createDataFrame(fixtures.TOOL_RESPONSES, "case_id string, tool_responses map<string, string>")
    got = {r.id: r.answer for r in sse.tool_answers(calls, responses).collect()}
    assert got == {1: "text of a", 2: "{}", 3: "12:00", 4: "{}", 5: "{}"}


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_framing_against_split(spark, span):
    rng = random.Random(span)
    bodies = {f"r{i}": "".join(rng.choice(["a", "bc", "\n", "é\r", " ", "\n\n"]) for _ in range(rng.randint(0, 80))) for i in range(30)}
    bodies |= {"none": "", "open": "never ended", "only": "\n", "long": "x" * 500 + "\n" + "y" * 20}
    rows = []
    for run, body in bodies.items():
        at, seq = 0, rng.randint(0, 50)
        while at < len(body):
            n = rng.randint(0, 5)
            rows.append((run, seq, body[at : at + n] or None))
            at, seq = at + n, seq + rng.randint(1, 9)
    chunks = spark.createDataFrame(rows, "run_id string, seq long, chunk string").repartition(5)
    got = {}
    for r in framing.lines(chunks, ("run_id",), span).collect():
        assert (r.run_id, r.line_no) not in got
        got[r.run_id, r.line_no] = r.line
    assert got == {(run, i): line for run, body in bodies.items() for i, line in enumerate(body.split("\n")[:-1])}


def test_a_long_run_is_framed_by_many_tasks(spark):
    chunks = spark.range(20_000).select(F.lit("one").alias("run_id"), F.col("id").alias("seq"), F.concat(F.col("id").cast("string"), F.lit(";\n").substr(F.lit(1), F.lit(1) + (F.col("id") % 2).cast("int"))).alias("chunk"))
    out = framing.lines(chunks, ("run_id",), 100)
    assert out.count() == 10_000 and out.where("line <> concat(2 * line_no, ';', 2 * line_no + 1, ';')").count() == 0
    windows = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if " Window " in x]
    assert any("range" in x and "seq" in x for x in windows)  # the windows over rows are within a range of chunks


def _line(text=None, **more):
    import json

    return "data: " + json.dumps({"choices": [{"delta": {"content": text} if text else {}, **more}]})


def test_completions_as_they_arrive(spark):
    done = "data: [DONE]"
    whole = [("a", 1, 0, 1.0, ": hello"), ("a", 1, 1, 1.5, _line("Hel")), ("a", 1, 2, 2.0, _line("lo")), ("a", 1, 3, 2.5, _line(finish_reason="stop")), ("a", 1, 4, 3.0, done)]
    batches = [
        [whole[4], whole[2], whole[2], ("b", 1, 0, 1.0, _line("never")), ("c", 1, 1, 4.0, done), ("d", 1, 0, 0.0, done)],
        [whole[0], whole[3], ("a", 1, 5, 3.5, _line("behind")), ("b", 1, 1, 1.5, "data: {broken"), ("d", 1, 1, 0.5, _line("late"))],
        [whole[1], whole[2], ("b", 1, 2, 2.0, _line(" ended")), ("c", 1, 2, 5.0, _line("late"))],
        [whole[1], ("a", 1, 6, 4.0, _line("late"))],
    ]
    path = counts.own_path(spark, "chunks")
    for rows in batches:
        spark.createDataFrame(rows, schemas.CHUNK).coalesce(1).write.mode("append").json(path)
    completions.flush_line(spark, 5.0).coalesce(1).write.mode("append").json(path)
    folded = completions.run_files(spark, path)
    got = {r.run_id: r for r in completions.completions(folded).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    told = {k: (r.ended, r.response_text, r.n_lines, r.n_late, r.finish_reason) for k, r in got.items()}
    assert told["a"] == ("done", "Hello", 5, 3, "stop")  # one behind the end mark, one delivered again after it, one later still
    assert told["b"] == ("time-out", "never ended", 3, 0, None)
    assert told["c"] == ("time-out", "", 1, 1, None)  # its first line never came
    assert told["d"] == ("done", "", 1, 1, None)
    assert (got["a"].ttft_s, got["a"].gen_s, got["a"].output_tokens_approx) == (1.5, 0.5, 1)


def test_streamed_tool_calls_are_those_of_the_batch(spark):
    lines = spark.createDataFrame([(r, n, s - 1, t, x) for r, n, s, t, x in fixtures.LINES], schemas.CHUNK)
    path = counts.own_path(spark, "chunks")
    lines.repartition(3, "seq").write.json(path)
    completions.flush_line(spark, 5.0).coalesce(1).write.mode("append").json(path)
    folded = completions.run_files(spark, path)
    want = sse.merge_calls(sse.call_deltas(sse.parse(lines))).collect()
    assert sorted(sse.merge_calls(completions.call_deltas(folded)).collect()) == sorted(want) and want
    plain = {(r.run_id, r.turn): r for r in sse.fold(sse.parse(lines)).collect()}
    for r in completions.completions(folded).collect():
        assert tuple(r[: len(r) - 3]) == tuple(plain.pop((r.run_id, r.turn)))
    assert not plain


def test_a_timer_that_was_put_off_rings_once_and_not_before():
    from types import SimpleNamespace as N

    state, timers, texts = {}, [], []
    facts = N(get=lambda: state.get("f"), update=lambda v: state.update(f=v), clear=lambda: state.pop("f"))
    fold = completions.Fold()
    fold.handle = N(registerTimer=timers.append, deleteTimer=lambda t: timers.remove(t))
    fold.facts, fold.lines = facts, N(appendList=texts.extend, get=lambda: iter(texts), clear=texts.clear)
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    row = lambda n, ms: Row(seq=n, at=at(ms), done=False, payload=True, arrival=float(n), content="x", reasoning=None, calls=None, finish_reason=None)
    ring = lambda t, mark: list(fold.handleExpiredTimer(("r", 1), N(getCurrentWatermarkInMs=lambda: mark), N(getExpiryTimeInMs=lambda: t)))
    silent = completions.SILENT_MS
    for n, ms in enumerate((1000, 5000, 9000)):
        assert list(fold.handleInputRows(("r", 1), iter([row(n, ms)]), None)) == []
    assert timers == [1000 + silent]  # one call for three batches
    assert ring(timers[-1], 2000 + silent) == [] and timers[-1] == 9000 + silent
    out = ring(timers[-1], 9000 + silent)
    assert [(r["ended"], r["n_lines"], r["response_text"]) for r in out] == [("time-out", 3, "xxx")] and timers[-1] == 9000 + 2 * silent
    assert ring(timers[-1], 9000 + 2 * silent) == [] and "f" not in state
