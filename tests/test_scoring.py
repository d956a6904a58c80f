"""Scorers against vectors and against plain statements of their rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import scoring, text
from tallyframe.plans.scoring_queries import _constraints
from tallyframe.sources import schemas

CALL = f"array<array<{schemas.CALL}>>"


def one(spark, column, schema="response string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("response", "expected", "score"),
    [
        ("42", "42", 5.0), ("The answer is 42.", "42", 3.0), ("41", "42", 0.0), ("  42 \n", "42", 5.0), ("`42`", "42", 5.0), ("yes", "YES", 3.0),
        ("A,B,D", "A, B, D", 0.0), ("131", "31", 3.0), ("a \n b", "a b", 3.0), ("", "", 5.0), ("x", "", 3.0),
        ("42\u00a0", "42", 5.0), ("\x1f`\u3000 42`", "42", 5.0), ("a\u2003\u2028b", "A B", 3.0), ("4\u200b2", "42", 0.0),
    ],
)
def test_exact(spark, response, expected, score):
    assert one(spark, scoring.exact(F.col("r"), F.col("e")), "r string, e string", (response, expected)) == score


@pytest.mark.parametrize(("words", "score"), [(["a", "b", "c", "d"], 5.0), (["a", "x", "y", "z"], 1.2), (["x", "y"], 0.0), ([], 0.0), (["A"], 5.0)])
def test_keywords(spark, words, score):
    assert one(spark, scoring.keywords(F.col("r"), F.col("w")), "r string, w array<string>", ("a b c d", words)) == score


CASES = [
    ("one two", {"word_count": 2}, 5.0), ("one two", {"word_count": 3}, 3.0), ("", {"word_count": 1}, 3.0), ("red blue", {"required_words": ["RED", "blue"]}, 5.0), ("red", {"required_words": ["red", "blue"]}, 4.0),
    ("abc", {"forbidden_chars": ["x"]}, 5.0), ("a,b;c", {"forbidden_chars": [",", ";"]}, 3.0), ("A", {"forbidden_chars": ["a"]}, 5.0), ("a\n\nb", {"line_count": 2}, 5.0), ("a\nb", {"line_count": 3}, 3.0),
    ("a b c", {"word_range": [2, 3]}, 5.0), ("a", {"word_range": [2, 3]}, 3.0), ("magical", {"forbidden_words": ["magic"]}, 4.0), ("- a\n* b\n• c", {"bullet_count": 3}, 5.0), ("a", {"bullet_count": 1}, 4.0),
    ("- a b\n* c", {"words_per_bullet": 2}, 4.5), ("no bullets", {"words_per_bullet": 2}, 5.0), ("x", {"required_elements": ["y"], "forbidden_elements": ["x"]}, 3.0), ("x", {"required_words": list("abcdefg")}, 0.0), ("x", {"no_punctuation": True}, 5.0),
]


def test_constraints(spark):
    fields = [x.name for x in schemas.struct("c " + schemas.CONSTRAINTS)["c"].dataType.fields]
    rows = [(t, tuple(c.get(k) for k in fields)) for t, c, _ in CASES]
    got = spark.createDataFrame(rows, f"r string, c {schemas.CONSTRAINTS}").select(scoring.constraints(F.col("r"), F.col("c")).alias("x")).collect()
    assert [g["x"] for g in got] == [s for _, _, s in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t-*•\u00a0\u2003\x85\x1c\u2028\u3000\u200b\x0b", max_size=20), min_size=1, max_size=20))
def test_text_helpers_follow_plain_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", text.strip("t").alias("s"), text.word_count("t").alias("w"), F.size(text.filled_lines("t")).alias("l"), F.size(text.bullets("t")).alias("b")).collect()
    for r in rows:
        t = texts[r["i"]]
        lines = [x for x in t.strip().split("\n") if x.strip()]
        assert (r["s"], r["w"], r["l"], r["b"]) == (t.strip(), len(t.split()), len(lines), sum(bool(re.match(r"[-*•]", x.strip())) for x in lines))


@pytest.mark.parametrize(
    ("calls", "args", "words", "score"),
    [
        ([], {"a": "1"}, None, 0.0), ([("f", '{"a": 1}')], {"a": "1"}, None, 5.0), ([("g", "{}")], {"a": "1"}, None, 0.0), ([("f", '{"a": 84.0}')], {"a": "84"}, None, 2.5), ([("f", "{broken")], {"a": "1"}, None, 2.5),
        ([("f", '{"a": 2}'), ("f", '{"a": 1}')], {"a": "1"}, None, 2.5), ([("f", '{"a": 1}')], {"a": "1"}, ["done", "no"], 3.75), ([("g", "{}")], {"a": "1"}, ["done"], 5.0), ([("f", '{"a": true}')], {"a": '"True"'}, None, 5.0), ([("f", "{}")], None, None, 2.5),
        ([("f", '{"a": [1, 2]}')], {"a": '"[1, 2]"'}, None, 5.0), ([("f", '{"a": "true"}')], {"a": "true"}, None, 2.5), ([("f", "[]")], {"a": "1"}, None, 2.5), ([("f", '{"a": null}')], {"b": "null"}, None, 5.0),
    ],
)
def test_tool_trace(spark, calls, args, words, score):
    trace = [[("id", n, x)] for n, x in calls]
    column = scoring.tool_trace(F.col("t"), F.lit("f"), F.col("a"), F.lit("all done"), F.col("w"))
    assert one(spark, column, f"t {CALL}, a map<string, string>, w array<string>", (trace, args, words)) == score


VALUES = [1, -3, 0, 1.5, 84.0, 1e5, 123456789.25, 1e16, 2e22, 1e-4, 1.5e-5, 3e-10, -0.0, True, False, None, "text", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there", [], [1, 2.0, "a", None, [True]], {"k": "v", "n": {"m": [1]}}]


def test_values_read_as_python_prints_them(spark):
    import json

    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, j string")
    got = {r["i"]: r["s"] for r in rows.select("i", scoring.python_text(F.col("j")).alias("s")).collect()}
    assert [got[i] for i in range(len(VALUES))] == [str(v) for v in VALUES]


@pytest.mark.parametrize(
    ("response", "reasoning", "reason", "category", "invalid"),
    [("", "", "stop", "math", True), ("x", "", "error", "math", True), ("x", "", "length", "math", True), ("x", "", "length", "creative", False), ("x", "", None, "math", False), (" ", "y", "stop", None, False), (None, None, None, None, True)],
)
def test_validity(spark, response, reasoning, reason, category, invalid):
    answer = scoring.scoreable(F.col("a"), F.col("b"))
    assert one(spark, scoring.is_invalid(answer, F.col("r"), F.col("c")), "a string, b string, r string, c string", (response, reasoning, reason, category)) == invalid


def test_router(spark):
    rows = [("exact", "42", None), ("exact", None, None), ("judge_keyword", None, ["4"]), (None, "42", None), ("unit_tests", None, None), ("constraint_check", None, None)]
    df = spark.createDataFrame(rows, "scoring string, expected string, expected_keywords array<string>").withColumns({"test_code": F.lit("t"), "constraints": F.lit(None).cast(schemas.CONSTRAINTS)})
    case = {c: F.col(c) for c in df.columns}
    got = df.select(scoring.route(F.lit("it is 42"), F.lit(False), case, unit_score=F.lit(1.0)).alias("r")).collect()
    assert [tuple(g["r"]) for g in got] == [(3.0, "exact"), (None, "needs_judge"), (5.0, "keyword"), (None, "needs_judge"), (1.0, "unit_test"), (None, "needs_judge")]
    assert tuple(one(spark, scoring.route(F.lit(""), F.lit(True), {k: F.lit(None) for k in df.columns} | {"expected_keywords": F.lit(None).cast("array<string>"), "constraints": F.lit(None).cast(schemas.CONSTRAINTS)}))) == (None, "invalid")


def test_bullets_are_counted_in_one_pass(spark):
    texts = ["- a b\n• c\n  * d e f", "\t- - • a\tb \r\n-\n--a b\nno - a b", "-\x85a b　\n•a b", "x\n\n \n - a b", "- a b", "", "-", "\n-\x0b*a b", "- a\n\n- b\nc"] + ["- " + "a" * 5000, " " * 5000 + "- a b" + " " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = [0, 1, 2, 3, -1]
    rows = df.select("i", text.bullet_count(F.col("t")).alias("b"), F.array(*(text.bullets_of(F.col("t"), F.lit(k)) for k in n)).alias("of")).collect()
    for r in rows:
        lines = [x.strip() for x in texts[r["i"]].strip().split("\n")]
        words = [len(re.sub(r"\A[-*• ]+", "", x).split()) for x in lines if re.match(r"[-*•]", x)]
        assert (r["b"], r["of"]) == (len(words), [words.count(k) for k in n]), texts[r["i"]]
    assert spark.createDataFrame([(None,)], "t string").select(text.bullet_count(F.col("t"))).first()[0] is None
    scored = df.select(scoring.penalties(F.col("t"), _constraints(words_per_bullet=F.lit(2)))["words_per_bullet"])
    assert "split(" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_lowered_once_for_all_words(spark):
    df = spark.createDataFrame([(1, "  The END\n", ["the", "end", "x"])], "id long, response string, words array<string>")
    for score in (scoring.keywords(F.col("response"), F.col("words")), scoring._missing(F.col("response"), F.col("words"))):
        plan = df.select(score)._jdf.queryExecution().optimizedPlan().toString()
        assert "contains(lower(response" not in plan and "lower(response" in plan
    assert "regexp" not in df.select(text.strip("response"))._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(scoring.keywords(F.col("response"), F.col("words"))).first()[0] == 3.3
