"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is a row. Its text is addressed by content (SHA-256), and a blob is scanned once for each
version of each rule, whatever number of paths or versions hold it: pairs of blob and rule version that the ledger has
already are left out, the rest are scanned, and findings of old and new pairs are joined back to all paths. The ledger is
asked by hashes alone; only texts of blobs that it lacks something for are moved and scanned. history() goes through
commits one by one, each with the ledger of those before.

A scan finds the leftmost non-overlapping matches of a rule. Spark's functions return matched strings without places,
so matches are wrapped in control characters by one regexp_replace and the places are summed up from the pieces between
them. Control characters that a text has itself are exchanged first, one for one, which moves nothing; no rule matches
them.

Texts of a blob meet in one task only after the map side has reduced each task's copies to one.

Defined results: a null text counts as empty; a null path is a path like any other; repeated rows are versions with the
same blob and get the same findings; an empty table gives empty ones. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, spread

_OPEN, _MID, _CLOSE, _OTHER = "\x01", "\x02", "\x03", "\x04"
FINDINGS = "array<struct<start: bigint, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. head and value are patterns without groups of their own; the value has least characters or the match is dropped, whole counts the head too."""

    kind: str
    version: int
    head: str
    value: str
    least: int
    whole: bool = False

    @property
    def pattern(self) -> str:
        return f"({self.head})({self.value})"


#: Fixed values, in the order in which ties are listed.
RULES = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", 1, "AKIA", "[A-Z0-9]+", 20, whole=True),
    Rule("hex", 1, "", "[0-9a-f]+", 24),
)


def spans(text: Column, rule: Rule) -> Column:
    """Places of the rule's matches in a text that holds none of the control characters."""
    marked = F.regexp_replace(text, rule.pattern, f"{_OPEN}$1{_MID}$2{_CLOSE}")
    step = lambda acc, piece: F.struct(  # noqa: E731  a piece: head, mid, value, close, what follows up to the next match
        (acc["at"] + F.length(piece) - 2).alias("at"),
        F.when(_size(piece, rule) >= rule.least, F.concat(acc["found"], F.array(_span(acc["at"], piece)))).otherwise(acc["found"]).alias("found"),
    )
    pieces = F.split(marked, _OPEN)
    start = F.struct(F.length(F.element_at(pieces, 1)).cast("long").alias("at"), F.array().cast(FINDINGS).alias("found"))
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)["found"]


def _size(piece: Column, rule: Rule) -> Column:
    head, close = F.instr(piece, _MID) - 1, F.instr(piece, _CLOSE) - 1
    return close - 1 if rule.whole else close - 1 - head


def _span(at: Column, piece: Column) -> Column:
    return F.struct(at.alias("start"), (at + F.instr(piece, _CLOSE) - 2).cast("long").alias("end"))


def _quick(rule: Rule) -> str:
    """A pattern that is found wherever a match of the rule that isn't dropped is; it may be found elsewhere."""
    least = rule.least - (len(rule.head) if rule.whole else 0)
    return f"{rule.head}{rule.value.removesuffix('+')}{{{max(1, least)},}}"


def blobs(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """All versions of all paths: path, text and blob."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return spread(docs.select(F.col(path_col).alias("path"), text.alias("text"))).withColumn("blob", F.sha2(F.encode("text", "utf-8"), 256))


def unseen(blobs: DataFrame, rules: Sequence[Rule], ledger: DataFrame) -> DataFrame:
    """Blobs that the ledger lacks a version of a rule for, with those that it has: blob, done."""
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    every = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    told = blobs.select("blob").distinct().join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    return told.where(F.size(F.array_except(every, "done")) > 0)


def scan(contents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """New rows for the ledger: blob, kind, version, found, for blobs with their text and what is done of them already.

    A pair without findings has a row too, with an empty list: it has been scanned.
    """
    clean = F.translate("text", _OPEN + _MID + _CLOSE, _OTHER * 3)
    nothing = F.array().cast(FINDINGS)
    each = [
        F.when(~F.array_contains("done", f"{r.kind}:{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.col("text").rlike(_quick(r)), spans(F.col("__clean"), r)).otherwise(nothing).alias("found")))
        for r in rules
    ]
    scanned = contents.withColumn("__clean", clean).select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s"))
    return scanned.select("blob", "s.kind", "s.version", "s.found")


def findings(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs: path_col, blob and a list of places for each rule, named by its kind; and the ledger's new rows.

    The ledger is a table of (blob, kind, version, found). Append the new rows to it once they are used.
    """
    versions = blobs(docs, path_col, text_col)
    one = F.first("text").alias("text")  # of each task's copies one is moved
    if ledger is None:
        contents = versions.groupBy("blob").agg(one).withColumn("done", F.array().cast("array<string>"))
    else:
        todo = cut(unseen(versions, rules, ledger), "blobs-unseen")
        marked = small(todo)
        contents = versions.join(marked.select("blob"), "blob", "left_semi").groupBy("blob").agg(one) if marked is not todo else versions.groupBy("blob").agg(one)
        contents = contents.join(marked, "blob")
    new = cut(scan(contents, rules), "blob-ledger")
    known = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    per_blob = known.where(current & (F.size("found") > 0)).groupBy("blob").agg(*(F.first(F.when(F.col("kind") == r.kind, F.col("found")), ignorenulls=True).alias(r.kind) for r in rules))
    joined = versions.select("path", "blob").join(per_blob, "blob", "left")
    lists = [F.coalesce(F.col(r.kind), F.array().cast(FINDINGS)).alias(r.kind) for r in rules]
    return joined.select(F.col("path").alias(path_col), "blob", *lists), new


def history(commits: Sequence[DataFrame], rules: Sequence[Rule] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """findings() of all versions of all commits in turn, each scanned with the ledger of those before; and the whole ledger."""
    found, ledger = findings(commits[0], rules, None, path_col, text_col)
    for docs in commits[1:]:
        more, new = findings(docs, rules, ledger, path_col, text_col)
        found, ledger = found.unionByName(more), ledger.unionByName(new)
    return found, ledger


def listed(rules: Sequence[Rule]) -> Column:
    """All places of the rules' lists as kind:start:end, by start and then in the rules' order, joined with commas."""
    def places(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), x["start"], x["end"]).alias("text")))

    every = F.concat(*(places(i, r.kind) for i, r in enumerate(rules)))
    return F.concat_ws(",", F.transform(F.array_sort(every), lambda x: x["text"]))
