"""Benchmark decontamination by spaced-seed hashing.

A text holds a benchmark item if some WINDOW words of the item stand in the text one after the other with at most
SUBSTITUTED of them replaced. An item of fewer words must stand there whole: with one word replaced if it has FEW_WORDS or
more, unchanged if it has less. Case and everything between words is ignored.

Fixed masks read some positions of a run of words and ignore the others, so that a replaced word under an ignored
position doesn't change the hash. Together the masks meet every way of replacing two words of a window: at least one
mask, somewhere in the window, reads none of them. The masks of a shorter item are its two halves, of one that must stand
unchanged all of it. Hashes of the item side are joined with those of the texts; around each hit the two are laid on each
other, once for each way to do so, and the windows that keep to the limit are verified word by word. The matched stretch
is all such windows that overlap.

The benchmark is taken in blocks of a bounded number of characters; each block's hashes are broadcast and joined with
the texts where they are, so no text or hash of a text moves, and a larger benchmark means more blocks, not larger ones.

Defined results: null and empty texts hold nothing; an item without words is in no text; repeated texts and items each
give their own rows; rows of a null id are reported with a null id; of equally long stretches the first in the text is
reported; an empty benchmark leaves everything as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .tokens import chunks, mix, words

WINDOW, SUBSTITUTED, FEW_WORDS = 13, 2, 5
#: Characters of the benchmark in one block.
BLOCK_CHARS = 2_000_000
#: The positions that each mask reads. Every pair of positions in a window is left out by some mask at some place.
MASKS = ((0, 1, 2, 4, 6, 7, 8), (0, 1, 3, 6, 7, 9, 10), (0, 1, 4, 5, 6, 9, 11))
_FACTOR = 0xD6E8FEB86659FD93
_FILTER_BITS = 22
#: Words of items that are compared with a text's at once.
LAID = 4_000_000


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash at each place of the words that the mask reads."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 64 + mask[-1], np.uint64)
    for p in mask:
        out = out * np.uint64(_FACTOR) + hashes[p : p + n]
    return mix(out)


def limit(n):
    """How many words of an item of n may be replaced in a window."""
    return np.where(n >= WINDOW, SUBSTITUTED, np.where(n >= FEW_WORDS, 1, 0))


class Block:
    """The items of a block, and for each mask a sorted table of seed, item and place."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words, self.first, _, _ = words([t for _, t in items])
        self.sizes = np.diff(self.first)
        short = sorted({n for n in self.sizes.tolist() if 0 < n < WINDOW})
        halves = [(n, part) for n in short for part in ([range(n // 2), range(n // 2, n)] if limit(n) else [range(n)])]
        self.masks = [*MASKS, *(tuple(part) for _, part in halves)]
        self.tables = []
        owner = np.repeat(np.arange(len(items)), self.sizes)
        for k, mask in enumerate(self.masks):
            key = seeds(self.words, mask)
            item, place = owner[: len(key)], np.arange(len(key)) - self.first[owner[: len(key)]]
            if k < len(MASKS):
                good = (self.sizes[item] >= WINDOW) & (place + mask[-1] < self.sizes[item])
            else:
                good = (self.sizes[item] == halves[k - len(MASKS)][0]) & (place == 0)
            key, item, place = key[good], item[good], place[good]
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[key >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((key[order], item[order], place[order], maybe))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, items and shifts (place among all words less place in the item): each way to lay an item on a text, once."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        most = int(self.sizes.max(initial=0))
        texts, span = len(first) - 1, len(hashes) + most + 1
        found = [np.zeros(0, np.int64)]
        for mask, (key, item, place, maybe) in zip(self.masks, self.tables, strict=True):
            s = seeds(hashes, mask)
            if not len(key) or not len(s):
                continue
            at = np.flatnonzero(maybe[s >> np.uint64(64 - _FILTER_BITS)])
            at = at[owner[at] == owner[at + mask[-1]]]
            low, high = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
            n = high - low
            row, at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(at, n)
            found.append(np.unique((item[row] * texts + owner[at]) * span + at - place[row] + most))
        every = np.unique(np.concatenate(found))
        pair, shift = every // span, every % span - most
        return pair % max(1, texts), pair // max(1, texts), shift

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, replaced words) of each longest stretch of a text and item."""
        hashes, first, _, _ = words(texts)
        text, item, shift = self.hits(hashes, first)
        begin = np.maximum(shift, first[text])  # an item may reach over a text's ends, a window may not
        n = np.minimum(shift + self.sizes[item], first[text + 1]) - begin
        good = n >= np.minimum(WINDOW, self.sizes[item])
        text, item, shift, begin, n = (x[good] for x in (text, item, shift, begin, n))
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + LAID, LAID)).tolist()  # so many words are laid on each other at once
        found = [self._stretches(hashes, *(x[a:b] for x in (text, item, shift, begin, n))) for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True) if a < b]
        if not found:
            return
        text, item, size, at, in_item, replaced = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-replaced, in_item, at, -size, item, text))
        text, item = text[order], item[order]
        best = np.ones(len(order), bool)
        best[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        columns = (text[best], item[best], (at[order] - first[text])[best], *(x[order][best] for x in (in_item, size, replaced)))
        yield from zip(*(c.tolist() for c in columns), strict=True)

    def _stretches(self, hashes: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item, words, place among all words, place in the item and replaced words of each stretch of each way to lay an item down."""
        total = int(n.sum())
        which, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        place = np.arange(total) - start[which] + begin[which]
        off = hashes[place] != self.words[self.first[item[which]] + place - shift[which]]
        before = np.concatenate([[0], np.cumsum(off)])
        size = np.minimum(WINDOW, self.sizes[item])
        whole = np.arange(total) + size[which] <= (start + n)[which]  # a window begins here
        at = np.flatnonzero(whole)
        at = at[before[at + size[which[at]]] - before[at] <= limit(self.sizes[item[which[at]]])]
        new = np.ones(len(at), bool)
        new[1:] = (which[at[1:]] != which[at[:-1]]) | (np.diff(at) > size[which[at[1:]]])  # windows that neither overlap nor touch
        low = at[new]
        high = at[np.append(new[1:], True)[: len(at)]] if len(at) else at
        own = which[low]
        end = high + size[own]
        return text[own], item[own], end - low, place[low], place[low] - shift[own], before[end] - before[low]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks, one after the other; the driver holds one at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    n = math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield Block([(r["id"], r["text"]) for r in own])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of docs and each item that it holds: id_col, item_col, text_word, item_word (first words of the longest stretch, from 0), n_words, n_replaced."""
    schema = "id long, item long, text_word long, item_word long, n_words long, n_replaced long"
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
                found = [(ids[at + t], shared.value.ids[i], *rest) for at, end in chunks(texts) for t, i, *rest in shared.value.scan(texts[at:end])]
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "text_word", "item_word", "n_words", "n_replaced"])

        own = rows.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; columns as they are, and no row moves."""
    docs = spread(docs)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(text_col).to_pylist()
                keep = np.ones(len(texts), bool)
                for at, end in chunks(texts):
                    keep[[at + t for t, *_ in shared.value.scan(texts[at:end])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
