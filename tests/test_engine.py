"""Readers, joins, collectors, streams and statistics; every query with an SQL twin is run against DuckDB."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyframe.operators import collect, external, pairs, reports, runs, statistics
from tallyframe.plans import catalogue
from tallyframe.sources import generators, readers, schemas
from tallyframe.streaming import counts, sse

DATA = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_twin_agree(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    twin = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert sorted(twin.columns) == order
    ours = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    theirs = [tuple(plain(r[twin.columns.index(c)]) for c in order) for r in twin.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


def test_readers(spark, tmp_path):
    suite = [{"id": "c1", "category": "math", "scoring": "exact", "expected": "1", "expected_args_contain": {"x": 84.0}}, {"id": "c2", "constraints": {"word_range": [1, 2]}}]
    (tmp_path / "suite.json").write_text(json.dumps(suite, indent=1))
    got = {r["id"]: r for r in readers.suite(spark, str(tmp_path / "suite.json")).collect()}
    assert got["c1"]["expected_args_contain"] == {"x": "84.0"} and got["c2"]["constraints"]["word_range"] == [1, 2] and got["c2"]["constraints"]["word_count"] is None
    assert readers.runs(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "t.jsonl").write_text('{"prompt_id": "p", "score_raw": 1.5, "metrics": {"gen_s": 2.0}}\n')
    assert readers.transcripts(spark, str(tmp_path / "t.jsonl")).first()["metrics"]["gen_s"] == 2.0
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.transcripts(spark, str(tmp_path / "bad.jsonl")).collect()
    for run, text in (("20260101_000000", '{"results": {"t": {"acc": 0.5}}}'), ("20260201_000000", '{"results":\n {"t": {"acc": 0.25}}}\n')):
        (tmp_path / "lm" / "m1" / run / "deep").mkdir(parents=True)
        (tmp_path / "lm" / "m1" / run / "deep" / "results.json").write_text(text)
    files = readers.result_files(spark, str(tmp_path / "lm"), "results.json")
    rows = collect.metrics(runs.latest_run(files), "lm-eval").collect()
    assert [(r["model"], r["task"], r["category"], r["score"]) for r in rows] == [("m1", "t", "acc", 0.25)]
    assert readers.result_files(spark, str(tmp_path / "absent"), "results.json").count() == 0
    readers.replace_csv(spark.createDataFrame([("m", 1.0)], "model string, score double"), str(tmp_path / "out"))
    readers.append(spark.range(2), str(tmp_path / "more"))
    readers.append(spark.range(2), str(tmp_path / "more"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["score"] == "1.0" and spark.read.parquet(str(tmp_path / "more")).count() == 4


def test_best_repeat_takes_the_first_of_equals_and_nulls(spark):
    df = spark.createDataFrame([("p", "m", 1, 2.0), ("p", "m", 2, 3.0), ("p", "m", 3, 3.0), ("q", "m", 4, None), ("q", "m", 5, None)], "prompt_id string, model_label string, seq int, score double")
    assert sorted(r["seq"] for r in runs.best_repeat(df, ["prompt_id", "model_label"]).collect()) == [2, 4]


def test_pairs_need_two_labels(spark):
    df = spark.createDataFrame([("p", "m", 1.0)], "prompt_id string, model_label string, score double")
    assert pairs.pairs(df).count() == 0


def test_micro_and_macro_means_differ(spark):
    rows = [("m", "f", "t1", 1.0), ("m", "f", "t1", 1.0), ("m", "f", "t2", 4.0)]
    df = spark.createDataFrame(rows, "model string, framework string, task string, score double")
    assert collect.macro_average(df).first()["macro"] == 2.5
    assert reports.leaderboard(df.select(F.col("model").alias("model_label"), F.lit(True).alias("valid"), "score")).first()["mean_score"] == 2.0


def test_top_tasks_keep_first_seen_order(spark):
    df = spark.createDataFrame([("m", "f", f"t{i}", 1.0, i) for i in range(7)], "model string, framework string, task string, score double, seq int")
    assert [r["task"] for r in collect.top_tasks(df).orderBy("rank").collect()] == ["t0", "t1", "t2", "t3", "t4"]


def test_sign_test_is_the_binomial_tail(spark):
    for wins, losses in ((9, 4), (0, 0), (5, 5), (120, 80)):
        rows = [(1.0, 0.0)] * wins + [(0.0, 1.0)] * losses + [(1.0, 1.0)]
        got = statistics.sign_test(spark.createDataFrame(rows, "a double, b double")).first()["p_value"]
        n = wins + losses
        assert got == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n), abs=1e-6)


def test_wilcoxon_shares_ranks(spark):
    rows = [(3.0, 1.0), (1.0, 3.0), (5.0, 1.0), (2.0, 2.0)]
    got = statistics.wilcoxon(spark.createDataFrame(rows, "a double, b double")).first()
    assert (got["n"], got["w_plus"], got["w_minus"]) == (3, 4.5, 1.5)


def test_streamed_counts_are_the_batch_counts(spark, tmp_path):
    rows = [(f"2026-01-0{1 + i % 3} 10:00:00", "click", float(i)) for i in range(9)]
    events = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp_ntz("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    batch = counts.counts(events).orderBy("window_start").collect()
    stream = counts.run_to_end(counts.counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))), str(tmp_path / "out")).orderBy("window_start").collect()
    assert batch == stream and [r["n"] for r in batch] == [3, 3, 3]


def test_chunks_can_be_streamed(spark, tmp_path):
    line = 'data: {"choices": [{"delta": {"content": "x"}}]}'
    (tmp_path / "c.json").write_text(json.dumps({"run_id": "r", "turn": 1, "seq": 1, "arrival": 1.0, "line": line}))
    parsed = sse.parse(readers.chunks(spark, str(tmp_path), stream=True))
    assert counts.run_to_end(parsed, str(tmp_path.parent / f"{tmp_path.name}-out"), "append").first()["content"] == "x"


def test_recorded_streams(spark, tmp_path):
    lines = ['data: {"choices": [{"delta": {"content": "a"}}]}', "", 'data: {"choices": [{"delta": {"content": "b"}, "finish_reason": "stop"}]}', "data: [DONE]"]
    (tmp_path / "run7.txt").write_text("\n".join(lines) + "\n" + 'data: {"choices": [{"delta": {"content": "cut"}}]}')
    row = sse.fold(sse.parse(readers.raw_streams(spark, str(tmp_path)))).first()
    assert (row["run_id"], row["response_text"], row["finish_reason"]) == ("run7", "ab", "stop")


def test_merging_keeps_order_of_first_sight(spark):
    rows = [("r", 1, 1, 1, "b", "g", "{"), ("r", 1, 2, 0, None, "f", "1"), ("r", 1, 3, 1, "", None, "}"), ("r", 1, 4, 0, "a", "", "2")]
    got = sse.merge_calls(spark.createDataFrame(rows, "run_id string, turn int, seq long, index int, id string, name string, arguments string")).first()["calls"]
    assert [tuple(c) for c in got] == [("b", "g", "{}"), ("a", "f", "12")]


def test_code_runs_only_when_asked(spark):
    cases = [("```python\nx = 1\n```", "assert x == 1"), ("x = 2", "assert x == 1"), ("while True: pass", ""), ("import time", "time.sleep(60)"), ("import os", "os.fork() or __import__('time').sleep(60)"), (None, "")]
    rows = spark.createDataFrame(cases, "response string, test_code string")
    with pytest.raises(PermissionError):
        external.unit_tests(rows)
    assert [r["unit_score"] for r in external.unit_tests(rows, enabled=True, seconds=2).collect()] == [5.0, 1.0, 0.0, 0.0, 5.0, None]


def test_programs_run_in_forks_of_one_interpreter_and_apart(spark):
    ends = ["import sys; sys.exit(0)", "import sys; sys.exit(3)", "import os; os._exit(0)", "import os; os.kill(os.getppid(), 9)", "x = (", "assert __name__ == '__main__'", "import atexit, os; atexit.register(os._exit, 7)"]
    apart = ["import builtins, os; builtins.seen = 1; open('f', 'w').write('x'); os.environ['A'] = 'b'", "import builtins, os; assert not hasattr(builtins, 'seen') and not os.listdir() and not os.environ", "print(input())", "import sys; sys.stdout.write('5\\n' * 9); sys.stdout.flush(); 1 / 0"]
    memory = ["x = 'a' * (1 << 30)", "```\nimport dataclasses\n@dataclasses.dataclass\nclass A:\n    x: int\nassert A(1) == A(1)\n```", "'a\0b'", "assert 'é\u2028' == '\\xe9\\u2028'"]
    rows = spark.createDataFrame([(c, "") for c in ends + apart + memory], "response string, test_code string").coalesce(1)
    assert [r["unit_score"] for r in external.unit_tests(rows, enabled=True, seconds=5).collect()] == [5.0, 1.0, 5.0, 0.0, 1.0, 5.0, 1.0] + [5.0, 5.0, 1.0, 1.0] + [1.0, 5.0, 0.0, 5.0]
    pids = spark.createDataFrame([("import os", f"assert os.getppid() > 1 and open('/proc/%d/cmdline' % os.getppid()).read().count('_serve')")] * 3, "response string, test_code string")
    assert {r["unit_score"] for r in external.unit_tests(pids, enabled=True).collect()} == {5.0}


def test_same_programs_run_once_a_task(spark, tmp_path):
    log = tmp_path / "log"
    code = f"```\nwith open('{log}', 'a') as f:\n    f.write('x')\n```"
    rows = spark.createDataFrame([(code, "")] * 50 + [(code, "1 / 0")] * 50, "response string, test_code string").coalesce(1)
    assert [r["unit_score"] for r in external.unit_tests(rows, enabled=True).collect()] == [5.0] * 50 + [1.0] * 50
    assert log.read_text() == "xx"


def test_retries_wait_longer_each_time_and_then_raise():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("gone")
        return "here"

    assert external.retried(call, sleep=waits.append) == "here" and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(ConnectionError):
        external.retried(call, attempts=2, sleep=waits.append)
    calls.clear()
    with pytest.raises(ConnectionError):
        external.retried(call, errors=(TimeoutError,), sleep=waits.append)


def test_judges_fall_back(spark):
    shown = spark.createDataFrame([("p1", "a"), ("p2", "b")], "prompt_id string, prompt string")
    got = external.judged(shown, lambda p: "one" if p == "a" else None, lambda p: "two").orderBy("prompt_id").collect()
    assert [(r["answer"], r["judge"]) for r in got] == [("one", "primary"), ("two", "second")]


def test_sweep_lengths(spark):
    rows = {r["target_tokens"]: r["prompt"] for r in generators.sweep(spark).collect()}
    assert rows[31] == generators.SHORT_PROMPT and len(rows[500]) <= 4 * 500 + 100 and len(rows[16000]) > 60_000


def test_schemas_parse():
    for ddl in (schemas.CASE, schemas.RUN, schemas.TRANSCRIPT, schemas.JUDGED, schemas.RESULT, schemas.CHUNK):
        assert schemas.struct(ddl).fields


def test_run_log_to_collector(spark, tmp_path):
    names = [f.name for f in schemas.struct(schemas.RUN).fields]
    rows = [{"model_label": "m", "prompt_id": f"p{i}", "category": "c", "score_raw": x, "score_type": "exact", "tok_per_s": t} for i, (x, t) in enumerate([("", "1"), ("None", "1"), ("0.0", "2.5"), ("5.0", "")])]
    (tmp_path / "runs.csv").write_text("\n".join([",".join(names), *(",".join(r.get(n, "") for n in names) for r in rows)]) + "\n")
    got = collect.custom(readers.runs(spark, str(tmp_path / "runs.csv")), seq=True).orderBy("seq").collect()
    assert [(r["task"], r["score"], r["tok_per_s"]) for r in got] == [("p2", 0.0, 2.5), ("p3", 5.0, 0.0)]
    typed = spark.createDataFrame([("m", "p", "c", 0.0, None, 1.5), ("m", "q", "c", None, "x", 1.5)], "model_label string, prompt_id string, category string, score_raw double, score_type string, tok_per_s double")
    assert [(r["task"], r["score"], r["score_type"]) for r in collect.custom(typed).collect()] == [("p", 0.0, "")]
    assert collect.aggregate(spark, str(tmp_path / "absent")).count() == 0


def test_last_run_without_results_hides_the_one_before(spark, tmp_path):
    root = f"file://{tmp_path}"
    readers.write_text(spark, '{"t": {"p": 0.5}}', f"{root}/bigcode/m/20260101_000000/metrics.json")
    readers.write_text(spark, '{"t": {"p": 0.9}}', f"{root}/bigcode/m/20260101_000000/deep/metrics.json")
    assert [r["score"] for r in collect.aggregate(spark, root).collect()] == [0.5]
    (tmp_path / "bigcode" / "m" / "20260102_000000").mkdir()
    assert collect.aggregate(spark, root).count() == 0


def test_unknown_models_are_an_error(spark):
    registry = spark.createDataFrame([("a", "org/a")], "model_label string, served_model string")
    assert runs.registered(spark.createDataFrame([("a",)], "model_label string"), registry).first()["served_model"] == "org/a"
    with pytest.raises(Exception, match="unknown model b"):
        runs.registered(spark.createDataFrame([("a",), ("b",)], "model_label string"), registry).collect()


def test_missing_pairs(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("q", "a", 1.0), ("r", "b", None), ("s", "c", 1.0)], "prompt_id string, model_label string, score double")
    assert {tuple(r) for r in pairs.missing(df).collect()} == {("q", True, False), ("r", False, True), ("s", False, False)}


def test_run_table_comes_from_transcripts(spark, tmp_path):
    line = {"bench_run_id": "b", "run_id": "r", "model_label": "m", "category": "creative", "prompt_id": "c1", "response": "four", "reasoning": "twelve chars", "repeat": 2, "seed": 42, "finish_reason": "stop", "score_raw": 5.0, "score_type": "exact", "metrics": {"ttft_s": 0.123456, "gen_s": 2.0, "tok_per_s": 1.2345}}
    readers.append(spark.read.schema(schemas.struct(schemas.TRANSCRIPT)).json(spark.sparkContext.parallelize([json.dumps(line)])), str(tmp_path / "t"), "json")
    transcripts = readers.transcripts(spark, str(tmp_path / "t"))
    cases = spark.createDataFrame([("c1", "creative", 0.7, None)], "id string, category string, temperature double, max_tokens int")
    registry = spark.createDataFrame([("m", "org/m", "q4")], "label string, served_model string, quant string")
    table = runs.run_table(transcripts, cases, registry)
    assert table.schema.names == schemas.struct(schemas.RUN).names
    row = table.first()
    assert (row["served_model"], row["max_tokens"], row["top_p"], row["ttft_s"], row["total_s"], row["tok_per_s"], row["valid"], row["score_raw"], row["seed"]) == ("org/m", 512, 0.95, 0.1235, 0.0, 1.23, True, "5.0", 42)
    assert collect.custom(table).first()["score"] == 5.0
    real = runs.real_throughput(transcripts, table).first()
    assert (real["model_label"], real["n"], real["mean_of_ratios"]) == ("m", 1, 2.0)
    other = transcripts.withColumn("run_id", F.lit("another"))
    assert runs.real_throughput(other, table).count() == 0


def test_metadata_and_keys(spark, tmp_path):
    root = f"file://{tmp_path}/deepeval"
    readers.write_text(spark, '{"model_label": "m", "elapsed_s": 1.5, "passed": true}', f"{root}/m/20260101_000000/run_meta.json")
    row = readers.run_meta(spark, root).first()
    assert (row["model"], row["elapsed_s"], row["passed"], row["quant"]) == ("m", 1.5, True, None)
    keyed = runs.keyed(spark.range(3), "s").collect()
    assert {r["bench_run_id"] for r in keyed} == {"s"} and len({r["run_id"] for r in keyed}) == 3 and all(len(r["run_id"]) == 8 for r in keyed)
    readers.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "r9.json").write_text('{"choices": [{"message": {"content": "x"}}]}')
    assert sse.whole(readers.responses(spark, str(tmp_path / "w"))).first()["run_id"] == "r9"


def test_statistics_of_many_rows(spark):
    many = spark.range(2_200_000).select((F.col("id") % 2).cast("double").alias("a"), F.lit(0.5).alias("b"))
    got = statistics.wilcoxon(many).first()
    assert got["n"] == 2_200_000 and got["w_plus"] == got["w_minus"] and got["z"] == 0.0
    assert statistics.sign_test(many).first()["p_value"] == pytest.approx(1.0, abs=1e-6)
    spread = spark.range(5000).select(F.col("id").cast("double").alias("a"), F.lit(1000.5).alias("b"))
    sizes = sorted((abs(i - 1000.5), i > 1000) for i in range(5000))
    ranks = {}
    for k, (size, _) in enumerate(sizes):
        ranks.setdefault(size, []).append(k + 1)
    assert statistics.wilcoxon(spread).first()["w_plus"] == sum(sum(ranks[s]) / len(ranks[s]) for s, plus in sizes if plus)


def test_words_inside_and_short_items(spark):
    from tallyframe.plans.scoring_queries import containment

    texts = [(1, "A b  c dd E"), (2, "xa b c"), (3, None), (4, "the quick brown fox"), (4, "no")]
    parts = [(1, "b  C d"), (2, "a B"), (3, ""), (4, None), (5, "QUICK brown f"), (6, "quick red f")]
    got = sorted(map(tuple, containment(spark.createDataFrame(texts, "id int, response string"), spark.createDataFrame(parts, "item_id int, text string")).collect()))
    assert got == sorted((i, k) for i, t in texts for k, p in parts if t is not None and p is not None and p.lower() in t.lower())
