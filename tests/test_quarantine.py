"""Rows that can't be used are kept with their reason, and counted in the pass that reads them."""

from pyspark.sql import functions as F

from tallyframe.operators import collect
from tallyframe.sources import quarantine
from tallyframe.streaming import counts

LINES = {
    ": comment": None, "": None, None: None, "  data: [DONE] ": None, 'data: {"choices": [{"delta": {"content": "x"}}]}': None, "data: {broken": "not JSON", "data: ": "no data line", 'data: {"choices": []}': "no choice",
    "data: {}": "no choice", "data: 7": "no choice", "event: ping": "no data line", "data:tight": "no data line",
}


def test_lines_are_divided_and_counted(spark):
    rows = spark.createDataFrame(list(enumerate(LINES)), "i long, line string").repartition(3)
    out = quarantine.divide(rows, quarantine.event_reason(F.col("line")), F.col("i"), F.col("line"), counts.own_path(spark, "q"), ("not JSON", "no choice"))
    assert {r.line for r in out.good.collect()} == {k for k, v in LINES.items() if v is None} and out.good.columns == ["i", "line"]
    dead = {(r.raw, r.reason, int(r.place)) for r in out.dead.collect()}
    assert dead == {(k, v, i) for i, (k, v) in enumerate(LINES.items()) if v}
    assert out.counts == {"n_read": 12, "n_good": 5, "n_not_JSON": 1, "n_no_choice": 3, "n_other": 3}
    scans = out.good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fault" in scans and scans.count("FileScan") == 1  # dead rows aren't opened


def test_no_rows_and_only_dead_ones(spark):
    none = spark.createDataFrame([], "i long, line string")
    out = quarantine.divide(none, quarantine.event_reason(F.col("line")), F.col("i"), F.col("line"), counts.own_path(spark, "q"), ("not JSON",))
    assert (out.good.count(), out.dead.count(), out.counts["n_read"]) == (0, 0, 0)
    bad = spark.createDataFrame([(1, "x")], "i long, line string")
    out = quarantine.divide(bad, quarantine.event_reason(F.col("line")), F.col("i"), F.col("line"), counts.own_path(spark, "q"), ())
    assert (out.good.count(), out.dead.count(), out.counts) == (0, 1, {"n_read": 1, "n_good": 0, "n_other": 1})


def test_skipped_files(spark):
    rows = {"a": '{"results": {"t": {}}}', "b": "{broken", "c": "", "d": None, "e": '{"result": 1}', "f": "[1]", "g": '{"results": 3}'}
    files = spark.createDataFrame([(k, "1", "x", v) for k, v in rows.items()], "model string, run_ts string, inner string, content string")
    assert {r.model: r.reason for r in collect.skipped(files, "lm-eval").collect()} == {"b": "not JSON", "c": "empty", "d": "empty", "e": "no object", "f": "no object", "g": "no object"}
    assert {r.model for r in collect.skipped(files, "bigcode").collect()} == {"b", "c", "d", "f"}
