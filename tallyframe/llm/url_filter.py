"""URL filters by a bit-parallel wildcard automaton.

Every glob rule is packed into one row of bits, a bit for each of its symbols, over as many 64-bit words as needed. One
Shift-And step for each character moves all rules at once: `((S << 1) | first) & accepts[c]`, plus `S & loops[c]` for
wildcards, which stay where they are. A batch of URLs is stepped together, the longest first, so that a step costs a
few numpy operations for the whole batch. Final bits seen at the end of a URL tell which rules fit it.

Globs: `*` is any run of characters but `/`, `**` any run at all, `?` one character but `/`; the rest stands for itself.
They are held against the canonical URL, host and path joined: the host is what follows the first `://` up to `/`, `?`,
`#` or the end, with A-Z lower-cased; the path goes on up to `?`, `#` or the end.

A rule (host, path) becomes the globs `host path**` and `*.host path**`; of the rules that fit, the longest wins, then
the first. Where none fits, the block patterns decide: any that fits blocks, else the URL is allowed.

Defined results: a null URL or one without `://` has an empty host and path, which no rule fits: it is allowed unless a
pattern fits the empty string; repeated rows are judged one by one; an empty table gives an empty one. Columns called
like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: URLs that are stepped together; bounds the memory of the states.
BATCH = 4096


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        own = _literal(self.host) + _literal(self.path) + "**"
        return own, "*." + own


def _literal(text: str) -> str:
    """Plain text as a glob: wildcard characters and backslashes get a backslash."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def parse(glob: str) -> list[str | None]:
    """Symbols: a character, or 'run', 'all' or 'one' (longer than a character) for `*`, `**` and `?`."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out.append(glob[i + 1])
            i += 2
        elif glob.startswith("**", i):
            out.append("all")
            i += 2
        else:
            out.append({"*": "run", "?": "one"}.get(glob[i], glob[i]))
            i += 1
    return out


class Automaton:
    """All globs at once. Each takes a bit for its start and one for each character or `?`; a run is a loop on the bit before it."""

    def __init__(self, globs: Sequence[str]):
        letters = sorted({s for g in globs for s in parse(g) if len(s) == 1})
        self.classes = {c: k + 2 for k, c in enumerate(letters)}
        self.classes.setdefault("/", 1)  # class 0: all characters that no glob names
        n_classes = len(letters) + 2
        bits, start, final = [], [], []
        for g in globs:
            start.append(len(bits))
            bits.append([set(), set()])  # classes that step in, classes that stay
            for s in parse(g):
                if s in ("run", "all"):
                    bits[-1][1] |= {c for c in range(n_classes) if s == "all" or c != self.classes["/"]}
                else:
                    bits.append([{self.classes[s]} if len(s) == 1 else {c for c in range(n_classes) if c != self.classes["/"]}, set()])
            final.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.accepts, self.loops = (np.zeros((n_classes, self.words), np.uint64) for _ in range(2))
        self.first = np.zeros(self.words, np.uint64)
        for b, (step, stay) in enumerate(bits):
            for table, where in ((self.accepts, step), (self.loops, stay)):
                for c in where:
                    table[c, b >> 6] |= np.uint64(1 << (b & 63))
        for b in start:
            self.first[b >> 6] |= np.uint64(1 << (b & 63))
        self.final = np.array(final, np.int64)
        self.table = np.zeros(0x110000, np.uint16)
        for c, k in self.classes.items():
            self.table[ord(c)] = k

    def fits(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            out[own] = self._step([texts[i] for i in own])
        return out

    def _step(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        chars = self.table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # texts are sorted, longest first
            c, s = chars[starts[:live] + step], state[:live]
            carry = np.zeros_like(s)
            carry[:, 1:] = s[:, :-1] >> np.uint64(63)
            state[:live] = (((s << np.uint64(1)) | carry) & self.accepts[c]) | (s & self.loops[c])
        return (state[:, self.final >> 6] >> (self.final & 63).astype(np.uint64)) & np.uint64(1) != 0


def host_and_path(url: str = "url"):
    """Columns host and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge(pages: DataFrame, rules: Sequence[Rule], block: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: id_col, host, path, rule (its text, or null), verdict."""
    rules = list(rules)
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    globs = [g for i in order for g in rules[i].globs] + list(block)
    names = np.array([*(rules[i].name for i in order), None], object)
    verdicts = np.array([*(rules[i].verdict for i in order), None], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for b in batches:
            fits = automaton.fits((b["host"] + b["path"]).tolist())
            own = fits[:, : 2 * len(rules)].reshape(len(b), len(rules), 2).any(axis=2)
            best = np.where(own.any(axis=1), own.argmax(axis=1) if len(rules) else 0, len(rules))
            fallback = np.where(fits[:, 2 * len(rules) :].any(axis=1), "block", "allow")
            yield b.assign(rule=names[best], verdict=np.where(best < len(rules), verdicts[best], fallback))

    host, path = host_and_path(url_col)
    rows = spread(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    out = rows.mapInPandas(run, f"id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
