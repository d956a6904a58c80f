"""Bulk-synchronous best-fit packing of token pieces into sequences of fixed capacity.

Pieces are taken in bands, the longest first (BANDS). Gaps are the free ends of open sequences. A superstep:

1. The band's pieces and all gaps that can hold one are sorted by size, the largest first, over range partitions. A gap
   that can hold several of the band's longest pieces is as many slots.
2. Each partition is swept once, in order. Gaps are laid on a stack; a piece's successor, the smallest gap that isn't
   smaller, is on top when the piece comes by. Several pieces may have one successor; such conflicts are resolved by rank:
   the longer piece has taken it, and the next finds the gap below.
3. What the sweeps leave over meets across partitions in the same way, in whole runs: a partition's pieces take from the
   gaps that those before it have left, the last first. Counts of each partition say which run goes with which.
4. Pieces meet their gaps by number, gaps shrink by what they took, and the next superstep begins.

After a band's supersteps sequences are opened for what stays over: for pieces of over half the capacity one each (with
no superstep, no gap can hold them), for pieces that a sequence holds few of, so many of neighbouring ranks each, for
small ones by windows of their running length. The number of supersteps depends on BANDS alone. Every table of the loop
has a row for each piece or gap and lies in the shared folder; the driver sees a few numbers of each partition.

Defined results: a null or empty text is one piece holding only the end token; a text of more than the capacity is cut
into pieces of the capacity, the last may be shorter; repeated rows and ids are pieces of their own; an empty table
gives an empty one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small, spread
from .tokens import chunks

#: Each band's longest piece, as a part of the capacity, and how many supersteps its pieces claim gaps in.
BANDS = ((1, 0), (2, 1), (3, 1), (4, 2), (6, 2), (8, 2), (12, 2), (16, 2), (32, 2), (64, 2), (128, 3))
#: Sequences are opened by ranks for pieces that one holds at most so many of.
FEW = 8

#: Words whose ids a worker keeps; the table starts anew beyond that.
CACHE_WORDS = 500_000
#: The splitting pattern that the fast path knows, and what it comes to for lower-cased text below U+0100.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS_FIRST = r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+"  # finds the same; a branch starts with what no other starts with
_LATIN = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+").findall
_ODD_SPACE = re.compile("[\x1c-\x1f]").search  # white space to Python only


class WordTokenizer:
    """ids of a tokenizer that splits into words before merging, through a table of words.

    The words are those of the vocabulary file's own normaliser and splitting pattern, so each has the same ids wherever
    it stands. Texts that hold a special token's string go to the tokenizer whole, as do all if the pattern is another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.known = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]] == [_KNOWN]
        self.words = regex.compile(_LETTERS_FIRST).findall
        vocabulary, suffix = self.tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.table: dict[str, int] = {}
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ids of word i: flat[starts[i]:starts[i + 1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        out: list[np.ndarray] = []
        for at, end in chunks(texts, 1 << 19):
            own = texts[at:end]
            whole = [not self.known or any(s in t for s in self.special) for t in own]
            words = [[] if w else self._split(t) for t, w in zip(own, whole, strict=True)]
            ids = self._look_up(words)
            for i in np.flatnonzero(whole).tolist():
                ids[i] = np.array(self.tokenizer.encode(own[i], add_special_tokens=False).ids, np.uint32)
            out += ids
        return out

    def _look_up(self, words: list[list[str]]) -> list[np.ndarray]:
        counts = np.cumsum([0, *map(len, words)])
        at = self._places(words, int(counts[-1]))
        if len(at) and at.min() < 0:
            every = chain.from_iterable(words)
            new = {w for w, k in zip(every, at.tolist(), strict=True) if k < 0}
            self._learn(sorted(new) if len(self.table) <= CACHE_WORDS else self._clear() or sorted(set().union(*words)))
            at = self._places(words, len(at))
        starts, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[counts].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _places(self, words: list[list[str]], n: int) -> np.ndarray:
        return np.fromiter(map(self.table.get, chain.from_iterable(words), repeat(-1)), np.int64, n)

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(self.tokenizer.normalizer.normalize_str(text))
        return self.words(self.tokenizer.normalizer.normalize_str(text)) if _ODD_SPACE(text) else _LATIN(text.lower())

    def _learn(self, new: list[str]) -> None:
        # the tokenizer normalises again, which leaves its own output as it is, and splits at the spaces
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(new) or sizes.sum() != len(ids):  # a word was split further, or the vocabulary doesn't mark ends
            each = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            ids, sizes = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
        n, used = len(self.table), int(self.starts[len(self.table)])
        while n + len(new) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(new)] = used + np.cumsum(sizes)
        self.table.update(zip(new, range(n, n + len(new)), strict=True))


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that tasks share the table of words."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, piece, start, length, ids_crc32, the ids themselves if asked for, and rid, a number of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, rid = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            ids = [None if none else i for i, none in zip(batch["id"].tolist(), batch["none"].tolist(), strict=True)]
            for i, encoded in zip(ids, tokenizer.encode([t or "" for t in batch["text"]]), strict=True):
                tokens = np.append(encoded, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    own = tokens[start : start + capacity]
                    out.append((i, k, start, len(own), zlib.crc32(own.tobytes()), rid, *([own.astype(np.int32)] if with_ids else [])))
                    rid += 1
            frame = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "rid", *(["ids"] if with_ids else [])])
            yield frame.assign(id=pd.array([x[0] for x in out], "Int64"))

    own_id = F.col(id_col).cast("long")  # pandas has no null integers
    rows = spread(docs.select(F.coalesce(own_id, F.lit(0)).alias("id"), own_id.isNull().alias("none"), F.col(text_col).alias("text")))
    schema = "id long, piece int, start long, length int, ids_crc32 long, rid long" + ", ids array<int>" * with_ids
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def bands(capacity: int) -> list[tuple[int, int, int]]:
    """(shorter than the shortest piece, longest piece, supersteps) of each band; all lengths are in one."""
    ends = [capacity // part for part, _ in BANDS] + [0]
    return [(low, high, n) for (_, n), high, low in zip(BANDS, ends, ends[1:], strict=False) if low < high]


SWEPT = "part int, kind int, id long, size long, seq long, at long, volume long"
MATCHED, PIECE, GAP = 0, 1, 2


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a partition's rows (size, piece, id), the largest first: pieces with the gap they take, pieces left over, then gaps left over. at numbers what is left over, volume is the tokens of pieces left over before."""
    part, stack, left, volume = TaskContext.get().partitionId(), [], 0, 0

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["kind", "id", "size", "seq", "at", "volume"]).assign(part=part)[["part", "kind", "id", "size", "seq", "at", "volume"]]

    for b in batches:
        out = []
        for size, piece, own in zip(b["size"].tolist(), b["piece"].tolist(), b["id"].tolist(), strict=True):
            if not piece:
                stack.append(own)
            elif stack:
                out.append((MATCHED, own, size, stack.pop(), 0, 0))
            else:
                out.append((PIECE, own, size, 0, left, volume))
                left, volume = left + 1, volume + size
        yield frame(out)
    for at in range(0, len(stack), 100_000):
        yield frame([(GAP, 0, 0, own, at + k, 0) for k, own in enumerate(stack[at : at + 100_000])])


def across(told: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """For partitions (part, pieces left, gaps left) in order: runs (part, first piece, beyond the last, gaps' part, beyond the last gap), pieces going up and gaps down; and how many pieces of each take a gap."""
    stack, runs, took = [], [], {}
    for part, pieces, gaps in told:
        at = 0
        while at < pieces and stack:
            where, low, high = stack.pop()
            n = min(pieces - at, high - low)
            runs.append((part, at, at + n, where, high))
            if high - n > low:
                stack.append((where, low, high - n))
            at += n
        took[part] = at
        if gaps:
            stack.append((part, 0, gaps))
    return runs, took


def superstep(pieces: DataFrame, gaps: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Matches pieces (rid, length) with gaps (seq, free): matched (rid, length, seq), those over (rid, length, part, nth, volume), their number, and the swept table, which can be released once these are used."""
    spark = pieces.sparkSession
    times = F.greatest(F.lit(1), F.floor(F.col("free") / high)).cast("int")
    slots = F.concat(F.array(F.col("free") - (times - 1) * high), F.array_repeat(F.lit(high).cast("long"), times - 1))
    both = pieces.select(F.col("length").cast("long").alias("size"), F.lit(1).alias("piece"), F.col("rid").alias("id")).union(
        gaps.where(F.col("free") > low).select(F.explode(slots).alias("size"), F.lit(0).alias("piece"), F.col("seq").alias("id"))
    )
    order = [F.desc("size"), F.col("piece"), F.col("id")]  # of equals the gap first
    swept = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_sweep, SWEPT), "swept")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    told = sorted(tuple(r) for r in swept.groupBy("part").agg(count(PIECE).alias("p"), count(GAP).alias("g")).collect())  # a row for each partition
    runs, took = across(told)
    over, offsets = 0, []
    for part, n, _ in told:
        offsets.append((part, took[part], over, [r[1:] for r in runs if r[0] == part]))
        over += n - took[part]
    plan = F.broadcast(spark.createDataFrame(offsets, "part int, took long, base long, runs array<struct<first: long, beyond: long, where: int, top: long>>"))
    waiting = swept.where(F.col("kind") == PIECE).join(plan, "part")
    own = F.try_element_at(F.filter("runs", lambda r: (r["first"] <= F.col("at")) & (F.col("at") < r["beyond"])), F.lit(1))
    claims = waiting.where("at < took").select(F.col("id").alias("rid"), F.col("size").alias("length"), own.alias("r"), "at")
    claims = claims.select("rid", "length", F.col("r.where").alias("part"), (F.col("r.top") - 1 - (F.col("at") - F.col("r.first"))).alias("at"))
    free = swept.where(F.col("kind") == GAP).select("part", "at", "seq")
    near = swept.where(F.col("kind") == MATCHED).select(F.col("id").alias("rid"), F.col("size").alias("length"), "seq")
    matched = near.unionByName(claims.join(free, ["part", "at"]).select("rid", "length", "seq"))
    left = waiting.where("at >= took").select(F.col("id").alias("rid"), F.col("size").alias("length"), "part", (F.col("base") + F.col("at") - F.col("took")).alias("nth"), "volume")
    return matched, left, over, swept


def opened(left: DataFrame, n: int, first: int, high: int, capacity: int) -> tuple[DataFrame, int]:
    """New sequences, numbered down from -first - 1, for the n pieces that stay over: (rid, length, seq); and how many."""
    each = capacity // high
    if each <= FEW:
        return left.select("rid", "length", (-first - 1 - F.floor(F.col("nth") / each)).alias("seq")), -(-n // each)
    window, before, bases = capacity - high + 1, 0, []  # what begins in a window ends within the capacity
    for r in sorted(left.groupBy("part").agg(F.min("volume").alias("low"), F.max(F.col("volume") + F.col("length")).alias("top")).collect()):  # a row for each partition
        bases.append((r["part"], before - r["low"]))
        before += r["top"] - r["low"]
    placed = left.join(F.broadcast(left.sparkSession.createDataFrame(bases, "part int, shift long")), "part")
    return placed.select("rid", "length", (-first - 1 - F.floor((F.col("volume") + F.col("shift")) / window)).alias("seq")), -(-before // window)


def sequences(sizes: DataFrame, capacity: int) -> DataFrame:
    """(rid, seq, length) for all pieces (rid, length)."""
    spark = sizes.sparkSession
    of_band = sum((F.col("length") <= low).cast("int") for low, _, _ in bands(capacity))
    counts = {r["k"]: r["n"] for r in sizes.groupBy(of_band.alias("k")).agg(F.count("*").alias("n")).collect()}  # a number for each band
    long = F.col("length") > bands(capacity)[0][0]
    placed = [cut(sizes.where(long).select("rid", F.col("length").cast("long").alias("length"), F.col("rid").alias("seq")), "placed")]  # one each, numbered like the piece
    gaps = cut(placed[0].select("seq", (capacity - F.col("length")).alias("free")).where("free > 0"), "gaps")
    first = 0
    for k, (low, high, tries) in enumerate(bands(capacity)):
        if not k or not counts.get(k):
            continue
        left, old = sizes.where((F.col("length") > low) & (F.col("length") <= high)).select("rid", "length"), None
        for t in range(max(1, tries)):
            matched, left, over, swept = superstep(left, gaps, low, high)
            done = t + 1 >= tries
            if over and done:
                new, n = opened(left, over, first, high, capacity)
                matched, first = matched.unionByName(new), first + n
            now = cut(matched.select("rid", "length", "seq"), "placed")
            both = gaps.select("seq", "free", F.lit(0).cast("long").alias("used")).union(now.select("seq", F.lit(None).cast("long"), "length"))
            after = both.groupBy("seq").agg((F.coalesce(F.max("free"), F.lit(capacity).cast("long")) - F.sum("used")).alias("free"))  # new ones were empty
            after = cut(after.where("free > 0"), "gaps")
            release(gaps, *([old] if old else []))
            placed.append(now)
            gaps, old = after, swept
            if done or not over:
                break
        release(old)
    release(gaps)
    return spark.read.schema(placed[0].schema).parquet(*(t.shared_path for t in placed))


def pack(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces()' rows."""
    rows = cut(rows, "pieces")
    seqs = sequences(rows.select("rid", "length"), capacity)
    before = Window.partitionBy("seq").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has no more pieces than tokens
    places = seqs.select("rid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return rows.join(places, "rid").drop("rid")
