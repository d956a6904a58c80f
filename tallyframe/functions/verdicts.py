"""Judge verdicts: prompts, blind order, parsing and putting back in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas
from . import text as t


#: The headings and the closing lines of the prompt, whose hash is an output.
HEADS = ("## Task\n", "\n\n## Candidate A\n", "\n\n## Candidate B\n")
CLOSING = "\n\nEvaluate both candidates against the task. Score each using the rubric.\nRespond with ONLY the JSON object."


def prompt(task: Column, a: Column, b: Column) -> Column:
    return F.concat(*(x for head, part in zip(HEADS, (task, a, b), strict=True) for x in (F.lit(head), part)), F.lit(CLOSING))


def swapped(prompt_id: Column) -> Column:
    """Whether a pair is shown in turned order: half of all prompts, by hash, so that a run can be repeated."""
    return F.pmod(F.conv(F.substring(F.md5(prompt_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1


def parse(answer: Column) -> Column:
    """The verdict in a judge's answer, null if there is none: fences are taken off, then all from the first { to the last }."""
    clean = t.strip(answer)
    fenced = F.regexp_replace(F.split_part(clean, F.lit("```"), F.lit(2)), r"\Ajson", "")
    body = F.when(F.startswith(clean, F.lit("```")), fenced).otherwise(clean)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    good = (found != "") & F.try_parse_json(found).isNotNull() & (F.regexp_replace(found, r"\s", "") != "{}")
    return F.when(good, F.from_json(found, schemas.struct("v " + schemas.VERDICT)["v"].dataType))


def unswap(verdict: Column, turned: Column) -> Column:
    """The verdict in the models' own order, defaults filled in: winner, a_score, b_score, violations_a, violations_b."""
    winner = F.coalesce(verdict["winner"], F.lit("tie"))
    back = F.when(winner == "A", "B").when(winner == "B", "A").otherwise("tie")
    score = lambda k: F.coalesce(verdict[k], F.lit(0.0))
    faults = lambda k: F.to_json(F.coalesce(verdict["violations"][k], F.array().cast("array<string>")))
    pick = lambda a, b: F.when(turned, b).otherwise(a)
    return F.struct(
        pick(winner, back).alias("winner"),
        pick(score("a_score"), score("b_score")).alias("a_score"),
        pick(score("b_score"), score("a_score")).alias("b_score"),
        pick(faults("A"), faults("B")).alias("violations_a"),
        pick(faults("B"), faults("A")).alias("violations_b"),
    )
