"""Scorers on a scale from 0 to 5, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .rounding import bound, half_even

FULL, PART, NONE = 5.0, 3.0, 0.0


def scoreable(response: Column, reasoning: Column) -> Column:
    """The stripped response, or the stripped reasoning where that is empty."""
    own = t.strip(F.coalesce(response, F.lit("")))
    return bound(own, lambda x: F.when(x != "", x).otherwise(t.strip(F.coalesce(reasoning, F.lit("")))))


def is_invalid(answer: Column, finish_reason: Column, category: Column) -> Column:
    """An error, no text, or cut off by length where the task isn't a creative one. A null finish reason is no fault."""
    cut = finish_reason.eqNullSafe("length") & ~category.eqNullSafe("creative")
    return finish_reason.eqNullSafe("error") | (answer == "") | cut


def exact(response: Column, expected: Column) -> Column:
    """5 if equal but for white space and backticks around, 3 if contained whatever the case and white space, else 0."""
    clean, wanted = t.strip(F.btrim(t.strip(response), F.lit("`"))), t.strip(expected)
    spaced = lambda c: t.strip(F.regexp_replace(c, f"{t.SPACE}+", " "))
    return bound(clean, lambda x: F.when(x == wanted, FULL).when(t.holds(x, wanted) | t.holds(spaced(x), spaced(wanted)), PART).otherwise(NONE))


def keywords(response: Column, words: Column) -> Column:
    """Share of keywords found, of 5, half-even to one place; 0 without keywords."""
    n, found = F.size(words), _present(response, words)
    return F.when(n > 0, half_even(F.lit(FULL) * found / n, 1)).otherwise(NONE)


#: Fixed value: how a fenced block of code is found.
FENCED = rf"(?s)```(?:python)?{t.SPACE}*\n(.*?)```"


def code(response: Column) -> Column:
    """The first fenced block; else all from the first line that begins a function or class; else the whole text."""
    fenced = F.regexp_extract(response, FENCED, 1)
    has_fence = response.rlike(FENCED)
    rows = F.split(response, "\n")
    starts = F.filter(F.transform(rows, lambda x, i: F.when(t.strip(x).rlike(r"\A(def |class )"), i)), lambda i: i.isNotNull())
    first = F.try_element_at(starts, F.lit(1))
    tail = F.array_join(F.slice(rows, F.coalesce(first, F.lit(0)) + 1, F.size(rows)), "\n")
    return F.when(has_fence, fenced).when(first.isNotNull(), tail).otherwise(response)


def _missing(response: Column, words: Column) -> Column:
    return bound(F.lower(response), lambda x: F.size(F.filter(words, lambda w: ~F.contains(x, F.lower(w)))))


def _present(response: Column, words: Column) -> Column:
    return bound(F.lower(response), lambda x: F.size(F.filter(words, lambda w: F.contains(x, F.lower(w)))))


def penalties(response: Column, c: Column) -> dict[str, Column]:
    """What each evaluated constraint takes off; null where a case doesn't have it."""
    words, bullets = t.word_count(response), t.bullet_count(response)
    wrong = bullets - t.bullets_of(response, c["words_per_bullet"])
    unless = lambda key, fine, points: F.when(c[key].isNotNull(), F.when(fine, 0.0).otherwise(points))
    each = lambda key, count, points=1.0: F.when(c[key].isNotNull(), count * F.lit(points))
    return {
        "word_count": unless("word_count", words == c["word_count"], 2.0),
        "required_words": each("required_words", _missing(response, c["required_words"])),
        "forbidden_chars": each("forbidden_chars", F.size(F.filter(c["forbidden_chars"], lambda x: F.contains(response, x)))),
        "bullet_count": unless("bullet_count", bullets == c["bullet_count"], 1.0),
        "words_per_bullet": each("words_per_bullet", wrong, 0.5),
        "line_count": unless("line_count", F.size(t.filled_lines(response)) == c["line_count"], 2.0),
        "word_range": unless("word_range", bound(words, lambda n: n.between(F.element_at(c["word_range"], 1), F.element_at(c["word_range"], 2))), 2.0),
        "required_elements": each("required_elements", _missing(response, c["required_elements"])),
        "forbidden_words": each("forbidden_words", _present(response, c["forbidden_words"])),
        "forbidden_elements": each("forbidden_elements", _present(response, c["forbidden_elements"])),
    }


def constraints(response: Column, c: Column) -> Column:
    """5 less all penalties, not below 0. c: a struct of schemas.CONSTRAINTS."""
    total = F.lit(0.0)
    for p in penalties(response, c).values():
        total = total + F.coalesce(p, F.lit(0.0))
    return F.greatest(F.lit(NONE), F.lit(FULL) - total)


#: Tokens of JSON text: strings, numbers, words and marks.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[a-z]+|[\[\]{},:]'


def _python_number(c: Column) -> Column:
    """A JSON number as Python prints it: whole ones as they are, others as the shortest float, without an exponent from 1e-4 up to 1e16."""
    d = c.try_cast("double")
    plain = F.regexp_replace(d.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(d.cast("string")), r"\.0e", "e"), r"e(\d)", "e+$1"), r"(?<=e[+-])(?=\d$)", "0")
    fits = ((F.abs(d) >= 1e-4) & (F.abs(d) < 1e16)) | (d == 0)
    plain = F.when((d == 0) & F.startswith(c, F.lit("-")), "-0.0").otherwise(plain)
    return F.when(c == "-0", "0").when(c.rlike(r"^-?[0-9]+$"), c).when(fits, plain).otherwise(short)


def _python_string(token: Column) -> Column:
    """A JSON string as Python prints it inside a list: in single quotes, in double ones if only that saves escapes."""
    raw = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        raw = F.replace(raw, F.lit(plain), F.lit(shown))
    double = F.contains(raw, F.lit("'")) & ~F.contains(raw, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), raw, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(raw, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _python_token(x: Column) -> Column:
    word = F.when(x == "true", "True").when(x == "false", "False").when(x == "null", "None").when(x == ",", ", ").when(x == ":", ": ")
    return word.when(F.startswith(x, F.lit('"')), _python_string(x)).when(x.rlike("^-?[0-9]"), _python_number(x)).otherwise(x)


def python_text(json: Column) -> Column:
    """JSON text of a value as Python's str() of that value; null is None."""
    string = F.get_json_object(F.concat(F.lit("["), json, F.lit("]")), "$[0]")
    printed = F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_JSON_TOKEN), F.lit(0)), _python_token), "")
    return F.when(json.isNull(), "None").when(F.startswith(json, F.lit('"')), string).otherwise(printed)


def json_fields(text: Column) -> Column:
    """The fields of a JSON object as a map from name to the JSON text of the value; null for what is no object."""
    kinds, raw = F.from_json(text, "map<string, variant>"), F.from_json(text, "map<string, string>")  # numbers as written are in raw alone
    own = lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.try_element_at(raw, k))
    return F.when(F.try_parse_json(text).isNotNull(), F.transform_values(kinds, own))


def tool_trace(trace: Column, tool: Column, args: Column, response: Column, words: Column) -> Column:
    """Half for a call of the expected tool, half for the share of expected arguments in the first such call; averaged with the keyword score where there are keywords.

    args: a map from name to the JSON text of the expected value. Values are compared as Python prints them, so that 84.0
    and 84 differ, as do true and "true"; a missing argument is None.
    """
    calls = F.filter(F.flatten(trace), lambda x: x["function_name"] == tool)
    first = F.try_element_at(calls, F.lit(1))
    pairs = F.map_entries(args)

    def share_of(actual: Column) -> Column:
        """actual is bound, so that it is parsed once, not for each expected argument and mention."""
        alike = lambda given, wanted: F.when(given == wanted, True).otherwise(bound(given, python_text) == bound(wanted, python_text))
        hits = F.size(F.filter(pairs, lambda e: alike(F.try_element_at(actual, e["key"]), e["value"])))
        return F.when(actual.isNotNull() & (F.size(pairs) > 0), F.lit(2.5) * hits / F.size(pairs)).otherwise(NONE)

    share = bound(json_fields(first["function_args"]), share_of)
    called = F.coalesce(F.when(tool.isNotNull() & (F.size(calls) > 0), F.lit(2.5) + share), F.lit(NONE))
    scored = keywords(response, words)
    with_words = F.when(called > 0, (called + scored) / 2).otherwise(scored)
    return F.least(F.lit(FULL), F.when(F.coalesce(F.size(words), F.lit(0)) > 0, with_words).otherwise(called))


def route(answer: Column, invalid: Column, case: dict[str, Column], trace: Column | None = None, unit_score: Column | None = None, response: Column | None = None) -> Column:
    """struct(score, score_type) by the case's way of scoring. Without the field it needs a way is passed over; what is left needs a judge.

    Keywords of a tool case are looked for in the response itself, not in the reasoning that may stand in for it.
    """
    way = F.coalesce(case["scoring"], F.lit("judge"))
    out = lambda score, kind: F.struct(score.cast("double").alias("score"), F.lit(kind).alias("score_type"))
    col = F.when(invalid, out(F.lit(None), "invalid"))
    col = col.when((way == "exact") & case["expected"].isNotNull(), out(exact(answer, case["expected"]), "exact"))
    col = col.when((way == "judge_keyword") & case["expected_keywords"].isNotNull(), out(keywords(answer, case["expected_keywords"]), "keyword"))
    if unit_score is not None:
        col = col.when((way == "unit_tests") & case["test_code"].isNotNull(), out(unit_score, "unit_test"))
    constrained = out(constraints(answer, case["constraints"]), "constraint")
    col = col.when((way == "constraint_check") & case["constraints"].isNotNull(), constrained)
    if trace is not None:
        traced = tool_trace(trace, case["expected_tool_call"], case["expected_args_contain"], answer if response is None else response, case["expected_keywords"])
        col = col.when(way.isin("tool_trace_exact", "tool_trace_judge"), out(traced, "tool_trace"))
    col = col.when((way == "judge_constraint") & case["constraints"].isNotNull(), constrained)
    return col.otherwise(out(F.lit(None), "needs_judge"))
