"""Result trees: odd names, what is opened, and literal results against their twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import collect
from tallyframe.plans import catalogue  # noqa: F401  registers
from tallyframe.plans.registry import LITERALS, QUERIES
from tallyframe.sources import readers, result_tree
from tallyframe.streaming import counts

NAMES = ["plain", "a b", "GLM-4.7-Flash (32K)", "50%+é#?", "a%20b", "ünïcode 模型", "lm-eval", "..x", "a=b&c", "'q\""]


@pytest.mark.parametrize("name", sorted(LITERALS))
def test_literal_rows_and_twin_agree(spark, name):
    run, sql = LITERALS[name]
    got, want = run(spark, "nowhere"), duckdb.sql(sql)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    plain = lambda rs: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rs)
    assert plain(got.select(*cols).collect()) == plain(rows) and rows


def tree(spark):
    root = counts.own_path(spark, "tree") + "/lm-eval"
    body = lambda x: f'{{"results": {{"t": {{"acc": {x}}}}}}}'
    rows = [(m, run, inner, body(x)) for i, m in enumerate(NAMES) for run, inner, x in (("20260101_000000", "results.json", 0.9), ("20260201_000000", "results.json", 0.1 + i / 100), ("20260201_000000", "deep er/é%/results.json", 0.5), ("20260201_000000", "run_meta.json", 0))]
    result_tree.save(spark.createDataFrame(rows, "model string, run_ts string, inner string, content string").repartition(4), root)
    return root


def test_every_model_comes_out_whatever_its_name(spark):
    root = tree(spark)
    files = result_tree.load(spark, root, "results.json")
    got = {(r.model, r.run_ts, r.latest, r.inner) for r in files.collect()}
    assert got == {(m, *x) for m in NAMES for x in (("20260101_000000", False, "results.json"), ("20260201_000000", True, "results.json"), ("20260201_000000", True, "deep er/é%/results.json"))}
    rows = collect.aggregate(spark, root.removesuffix("/lm-eval")).collect()
    assert {r.model for r in rows} == set(NAMES) and len(rows) == 2 * len(NAMES)
    assert {r.score for r in rows if r.model == "a b"} == {0.11, 0.5}
    direct = result_tree.load(spark, root, "results.json", direct=True).where("latest")
    assert direct.count() == len(NAMES) and {r.inner for r in direct.collect()} == {"results.json"}


def test_only_runs_that_are_asked_for_are_opened(spark):
    root = tree(spark)
    files = result_tree.load(spark, root, "results.json")
    assert files.rdd.getNumPartitions() == 2 * len(NAMES)
    for where, n in (("latest", len(NAMES)), ("latest = true and model in ('a b', 'plain', 'none')", 2), ("model = '50%+é#?' and run_ts = '20260101_000000'", 1), ("not latest", 2 * len(NAMES)), ("model = 'none'", 1)):
        one = files.where(where)
        assert one.rdd.getNumPartitions() == n, where
    assert files.where("not latest").count() == len(NAMES) and files.where("model = 'none'").count() == 0
    assert files.where("latest and content like '%0.11%'").select("model").collect()[0].model == "a b"


def test_a_stray_file_that_sorts_last_is_the_latest_entry(spark):
    root = counts.own_path(spark, "tree")
    readers.write_text(spark, '{"results": {"t": {"acc": 0.5}}}', f"{root}/m/20260101_000000/results.json")
    assert result_tree.load(spark, root, "results.json").where("latest").count() == 1
    readers.write_text(spark, "stray", f"{root}/m/notes.txt")
    assert result_tree.load(spark, root, "results.json").where("latest").count() == 0
    assert result_tree.load(spark, root, "results.json").count() == 1
    assert result_tree.load(spark, root + "/absent", "results.json").count() == 0


@pytest.mark.parametrize("place", [("a/b", "r", "x"), ("m", "..", "x"), ("m", "r", "../x"), ("m", "r", "")])
def test_places_outside_a_tree_are_refused(spark, place):
    with pytest.raises(Exception, match="not a place"):
        result_tree.save(spark.createDataFrame([(*place, "")], "model string, run_ts string, inner string, content string"), counts.own_path(spark, "tree"))


def test_a_query_over_a_missing_folder_fails(spark):
    for name in ("result_tree", "collect_custom", "aggregate_files", "sse_parse", "stream_fold", "completion_fold", "line_framing"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            QUERIES[name](spark, "/nowhere").select(F.lit(1)).count()
