"""Line dedup by a segment-partition edit join.

Lines are what newlines separate, trimmed; empty ones are no lines. Two lines are alike if they are equal, or if few edits
(insertions, deletions, substitutions of characters) lie between them: as many as the shorter one has times NEAR_CHARS
characters, EDITS at most, so none for lines that are shorter still. Classes are the components of alike lines; the first
line of each stays, by doc_id and place, and every other is taken out of its text.

The join, for each number of edits: a line cut into one segment more must share one unchanged with any line so many edits away. Each line
files its own segments, by length and segment number, and probes with those of its substrings that can be a segment of
a line 0 to EDITS characters shorter (only the starts that the other segments' edits allow). Rolling hashes give all of
them for a batch of lines at once. Lines that share a filed substring are candidates; a banded bit-parallel edit
distance verifies them, many pairs in step. Copies of a line are one item, and a bucket's pairs are not all made (see
links.py; edit distance is a metric). In step 2 there a line is the set of its runs of GRAM characters, each with its
number among equals: an edit changes GRAM of them at most, so lines that are alike share all but EDITS * GRAM. Nor can
more than EDITS characters, or twice as many pairs of neighbours, be in one and not in the other.

With `every`, lines of WORD_CHARS characters and FEW_WORDS words are alike too if at most one word in so many, of the
shorter line's and one at least, is edited. Words are what blanks separate, and each character of a script written without
blanks. They are joined as above, words in the place of characters, with segments for each number of edits; for one edit
the segments are the words, all but one of which must be shared, since the halves of a short line say too little. Lines of
4 * every words and more, whose segments would be too many, file their rarest runs of RUN words: an edit changes RUN of
them at most, so if all lines put their runs in one order, the first run that two such lines share is among the first
RUN * edits + 1 of each. The order puts runs first that all lines have least often, by counts in SLOTS slots, so what
very many lines share, such as a passage, brings none of them together. Any order loses nothing. The first run that no
edit changes is one of these too, and its place and the line's length differ by the edits at most between two alike lines:
lines that have a run by chance, at places or in lengths too far apart, do not meet (see links.shared_buckets).

Defined results: a null text has no lines and stays null; a null id comes after all others; rows alike in id and text
are one document and treated alike; a document all of whose lines go is left with an empty text; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import links
from .common import cut, doc_key, release, small, spread, tidy
from .tokens import chunks, mix, shingles

MIN_CHARS, NEAR_CHARS, EDITS, GRAM = 1, 20, 2, 6
#: Characters of a line that is compared by words.
WORD_CHARS = 40
#: Lines that a task remembers to have filed, so that a very common one is filed once a task.
FILED = 300_000
#: For comparing words: one in EVERY may be edited, in lines of FEW_WORDS and more; RUN words make a key of a long line.
EVERY, FEW_WORDS, RUN = 10, 5, 4
#: Runs are counted by their hashes in so many slots, a power of two: what a task sends of its counts and what all tasks are sent back.
SLOTS = 1 << 16
#: Of a long line's run: the line's words, and the run's first and last place there. Larger ones than TOP, which are rare, are taken to be TOP, and such a line's places to be any.
SPOT, TOP = ("size", "low", "high"), (1 << 15) - 1
#: Pairs that are worth a task of their own.
PAIRS = 256
#: Parts that the buckets are joined in with `every`, by characters and by words: lines have some 10 and 20 buckets each, few of them shared, so disk is saved for hashing anew.
CHAR_PARTS, WORD_PARTS = 2, 3
#: Rows of labels that are broadcast at most; the lines they are joined with are small numbers too.
FEW = 50_000
#: What is trimmed from a line's ends.
SPACE = " \t\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def allowed(n, edits: int = EDITS, near: int = NEAR_CHARS):
    """How many characters may be edited if the shorter line has n."""
    return np.minimum(edits, n // near)


def char_buckets(lines: list[str], edits: int = EDITS, near: int = NEAR_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by characters of a batch of lines, and which line each is of, for all numbers of edits."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for e in range(1, edits + 1):
        own = [i for i, x in enumerate(lines) if len(x) >= e * near and (e == edits or len(x) < (e + 1) * near + e)]
        key, owner = buckets([lines[i] for i in own], e, e * near, (e + 1) * near if e < edits else 1 << 62)
        keys.append(mix(key + np.uint64(e)))
        owners.append(np.array(own, np.int64)[owner])
    return np.concatenate(keys), np.concatenate(owners)


def buckets(lines: list[str], edits: int, near: int, top: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch of lines, and which line each is of. Lines with under `near` characters have none, and none of `top` or more is filed.

    For each number of characters that a filed line may be shorter, each of its segments and each shift that the edits
    before and behind the segment allow, all lines are probed at once. With nothing shorter and no shift, a line files.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    room = 1 << max(10, int(len(chars)).bit_length())  # few sizes, so that the tables of powers are kept
    before = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * _powers(_BASE, room)[: len(chars)], out=before[1:])
    back = _powers(_INVERSE, room)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for shorter in range(edits + 1):
        own = np.flatnonzero((sizes - shorter >= near) & (sizes - shorter < top))
        other, n, at = sizes[own] - shorter, sizes[own], begins[own]
        for i in range(edits + 1):
            start, end = i * other // (edits + 1), (i + 1) * other // (edits + 1)
            tag = mix((other * (edits + 1) + i).astype(np.uint64))
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                s, e = start + shift, end + shift
                good = (s >= 0) & (e <= n)
                s, e = (at + s)[good], (at + e)[good]
                keys.append(mix(((before[e] - before[s]) * back[s]) ^ tag[good]))
                owners.append(own[good])
    return np.concatenate(keys), np.concatenate(owners)


def word_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all lines, and the offset of each line's first word (one more than lines)."""
    chars = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(chars.max(initial=0))
    blank = (chars <= 32) | (chars == 0xA0)
    if top >= 0x2000:
        blank |= (chars == 0x3000) | ((chars >= 0x2000) & (chars <= 0x200A))
    alone = np.zeros(len(chars), bool)
    for low, high in () if top < 0xE00 else ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        alone |= (chars >= low) & (chars <= high)
    start = ~blank
    start[1:] &= blank[:-1] | alone[1:] | alone[:-1]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lines)]))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    room = 1 << max(10, int(len(chars)).bit_length())
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(np.where(blank, np.uint32(0), chars + np.uint32(1)) * _powers(_BASE, room)[: len(chars)], out=sums[1:])
    return mix(np.diff(sums[np.append(starts, len(chars))]) * _powers(_INVERSE, room)[starts]), first


def as_chars(codes: np.ndarray, first: np.ndarray) -> list[str]:
    """A string for each line with a character for each word; equal codes, equal characters."""
    codes = codes % 0x10F000
    whole = (codes + np.where(codes >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def one_word_buckets(hashes: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by which lines of FEW_WORDS to `most` words meet if one word is edited: segments are words, and all but one are shared.

    A line files itself and itself without each of its words, so two lines that meet are at most two words apart.
    """
    sizes = np.diff(first)
    good = (sizes >= FEW_WORDS) & (sizes <= most)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - first[owner]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(np.where(good[owner], hashes * _powers(_BASE, most + 1)[np.minimum(place, most)], np.uint64(0)), out=sums[1:])
    own, lines = np.flatnonzero(good[owner]), np.flatnonzero(good)
    start, end = first[:-1][owner[own]], first[1:][owner[own]]
    without = sums[own] - sums[start] + (sums[end] - sums[own + 1]) * np.uint64(_INVERSE)
    whole = sums[first[1:][lines]] - sums[first[:-1][lines]]
    keys, owners = np.concatenate([without, whole]), np.concatenate([owner[own], lines])
    count = sizes[owners] - (np.arange(len(owners)) < len(own))
    return mix(keys ^ mix(count.astype(np.uint64) + np.uint64(1))), owners


def long_runs(hashes: np.ndarray, first: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of RUN words of the lines of 4 * every words and more, and which line each is of."""
    sizes, runs = np.diff(first), shingles(hashes, RUN)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = (owner[: len(runs)] == owner[RUN - 1 :]) & (sizes[owner[: len(runs)]] >= 4 * every)
    return runs[inside], owner[: len(runs)][inside]


def slots(runs: np.ndarray) -> np.ndarray:
    return (runs % np.uint64(SLOTS)).astype(np.int64)


def rare_runs(hashes: np.ndarray, first: np.ndarray, every: int, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first RUN * edits + 1 distinct runs of each line of long_runs(), by the levels of their slots, which line each is of, and its SPOT."""
    runs, owner = long_runs(hashes, first, every)
    at = np.arange(len(runs)) - np.searchsorted(owner, owner)
    if levels is not None:
        runs = (levels[slots(runs)].astype(np.uint64) << np.uint64(56)) | (runs >> np.uint64(8))  # the level leads the order
    order = np.lexsort((runs, owner))  # stable, so equal runs of a line are in the order of their places
    runs, owner, at = runs[order], owner[order], at[order]
    new = np.ones(len(runs) + 1, bool)
    new[1:-1] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    new = np.flatnonzero(new[: len(runs) + bool(len(runs))])
    runs, owner, low, high = runs[new[:-1]], owner[new[:-1]], at[new[:-1]], at[new[1:] - 1]
    place = np.arange(len(runs)) - np.searchsorted(owner, owner)
    sizes = np.diff(first)[owner]
    kept = place <= RUN * word_limit(sizes, every)
    wide = sizes > TOP
    spot = np.stack([np.minimum(sizes, TOP), np.where(wide, 0, low), np.where(wide, TOP, high)], 1)
    return mix(runs[kept]), owner[kept], spot[kept].astype(np.int16)


def word_buckets(lines: list[str], every: int = EVERY, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by words of a batch of lines, and which line each is of. levels: of all slots, see run_levels()."""
    return placed_word_buckets(lines, every, levels)[:2]


def placed_word_buckets(lines: list[str], every: int = EVERY, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_buckets() and a SPOT for each, zeros where the bucket itself tells lengths and places apart."""
    hashes, first = word_hashes(lines)
    sizes, words = np.diff(first), as_chars((hashes >> np.uint64(1)).astype(np.int64), first)
    one, own = one_word_buckets(hashes, first, 2 * every)
    keys, owners = [one], [own]
    for edits in (2, 3):
        near, top = edits * every, (edits + 1) * every
        own = np.flatnonzero((sizes >= near) & (sizes < top + edits))
        key, owner = buckets([words[i] for i in own], edits, near, top)
        keys.append(mix(key + np.uint64(edits)))
        owners.append(own[owner])
    key, owner, spot = rare_runs(hashes, first, every, levels)
    spots = np.concatenate([np.zeros((sum(map(len, keys)), len(SPOT)), np.int16), spot])
    keys.append(key)
    owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners), spots


def _common(x: str, y: str, same) -> int:
    """The largest n up to the length of x for which same(n)."""
    low, high = 0, len(x)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(mid) else (low, mid - 1)
    return low


def edit_distances(a: list[str], b: list[str], limit: int) -> np.ndarray:
    """Edit distance of each pair of strings, limit + 1 where it is more. Common ends are cut off first, then pairs are stepped together."""
    out = np.zeros(len(a), np.int64)
    cores, at = [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if len(y) - len(x) > limit:
            out[k] = limit + 1
        elif x != y:
            front = _common(x, y, lambda n, x=x, y=y: y.startswith(x[:n]))
            x, y = x[front:], y[front:]
            end = _common(x, y, lambda n, x=x, y=y: y.endswith(x[len(x) - n :]))
            x, y = x[: len(x) - end], y[: len(y) - end]
            out[k] = len(y)
            if x:
                cores.append((x, y))
                at.append(k)
    for s in range(0, len(cores), 8192):
        out[at[s : s + 8192]] = _band(cores[s : s + 8192], limit)
    return out


def _band(pairs: list[tuple[str, str]], limit: int) -> np.ndarray:
    """Distances of (pattern, text) pairs, the pattern no longer than the text and at most `limit` shorter.

    Bit w of column j stands for pattern row j - limit + w; vp and vn say where a column grows or falls from row to row.
    Rows above the pattern are level and match nothing; cells outside the band are taken to grow, which only
    overestimates what is over the limit anyway. The score is followed along the diagonal up to the pattern's last row
    and along that row to the text's end. A distance within the limit keeps it within twice the limit on the way.
    """
    width, one = 2 * limit + 1, np.uint64(1)
    full, top = np.uint64((1 << width) - 1), np.uint64(1 << (width - 1))
    n = len(pairs)
    m = np.array([len(x) for x, _ in pairs], np.int64)
    t = np.array([len(y) for _, y in pairs], np.int64)
    margin = 0x110000  # no character
    pad = limit + width
    size = m + 2 * pad
    pattern = np.full(int(size.sum()), margin, np.uint32)
    p_at = np.cumsum(size) - size + pad
    pattern[np.repeat(p_at - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] = np.frombuffer("".join(x for x, _ in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.frombuffer("".join(y for _, y in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
    t_at = np.cumsum(t) - t
    vp = np.full(n, sum(1 << w for w in range(limit + 1, width)), np.uint64)  # column 0: rows from 1 on grow
    vn, score, result = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, limit + 1, np.int64)
    live, j = np.arange(n), 0
    while len(live):
        j += 1
        p, v = (vp[live] >> one) | top, vn[live] >> one  # the window moves down a row
        c = text[t_at[live] + j - 1]
        eq = np.zeros(len(live), np.uint64)
        for w in range(width):
            eq |= (pattern[p_at[live] + j - limit + w - 1] == c).astype(np.uint64) << np.uint64(w)
        d0 = ((((eq & p) + p) ^ p) | eq | v) & full
        hp, hn = (v | ~(d0 | p)) & full, d0 & p
        past = np.maximum(j - m[live], 0)
        bit = (limit - past).astype(np.uint64)
        along = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
        score[live] += np.where(past > 0, along, 1 - ((d0 >> bit) & one).astype(np.int64))
        hp, hn = ((hp << one) | one) & full, (hn << one) & full
        vp[live], vn[live] = (hn | ~(d0 | hp)) & full, d0 & hp
        done = t[live] == j
        result[live[done]] = np.minimum(score[live[done]], limit + 1)
        live = live[~done & (score[live] <= 2 * limit)]
    return result


def word_limit(n, every: int = EVERY):
    """How many words may be edited if the shorter line has n."""
    return np.maximum(1, n // every)


def _long_distance(x: str, y: str, limit: int) -> int:
    """Edit distance of two strings, limit + 1 where it is more, row by row over a band; for limits that _band has no bits for."""
    a, b = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in sorted((x, y), key=len))
    if len(b) - len(a) > limit:
        return limit + 1
    at = np.arange(2 * limit + 1)
    row = np.where(at >= limit, at - limit, limit + 1)  # column j of row i is at j - i + limit
    padded = np.full(len(b) + 2 * limit + 1, 0x110000, np.uint32)
    padded[limit : limit + len(b)] = b
    for i in range(1, len(a) + 1):
        other = padded[i - 1 : i + 2 * limit] != a[i - 1]
        new = np.minimum(row + other, np.append(row[1:], limit) + 1)
        j = i + at - limit
        new = np.where(j < 0, limit + 1, np.where(j == 0, i, new))
        row = np.minimum(np.minimum.accumulate(new - at) + at, limit + 1)
    return int(row[len(b) - len(a) + limit])


def _widening(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """Edit distances as far as each pair's limit: all pairs with a narrow band, and with wider ones those that it doesn't settle."""
    out, tried = np.ones(len(a), np.int64), 0
    for band in (3, 7, 31):
        at = np.flatnonzero((out > tried) & (limits > tried))
        out[at] = edit_distances([a[i] for i in at], [b[i] for i in at], band)
        tried = band
    for i in np.flatnonzero((out > tried) & (limits > tried)):
        out[i] = _long_distance(a[i], b[i], int(limits[i]))
    return out


def lacking(codes: np.ndarray, sizes: np.ndarray, pairs: int) -> np.ndarray:
    """For pairs of lines (the first half of the lines with the second) how many words of one, counted as often as they stand there, the other lacks; the larger of both ways. No fewer are edited."""
    line = np.repeat(np.arange(2 * pairs), sizes)
    pair, sign = line % max(1, pairs), np.where(line < pairs, 1, -1)
    keys, at = np.unique(pair * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    excess = np.bincount(at, sign, len(keys))
    own = keys // (int(codes.max(initial=0)) + 1)
    return np.maximum(np.bincount(own, np.maximum(excess, 0), pairs), np.bincount(own, np.maximum(-excess, 0), pairs)).astype(np.int64)


def word_distances(a: list[str], b: list[str], every: int = EVERY) -> np.ndarray:
    """Edited words of each pair of lines as a share of how many may be; over 1 where they are not alike."""
    hashes, first = word_hashes(a + b)
    codes, sizes = np.unique(hashes, return_inverse=True)[1], np.diff(first)
    least = np.minimum(sizes[: len(a)], sizes[len(a) :])
    limits, out = word_limit(least, every), np.full(len(a), 3.0)
    at = np.flatnonzero((least >= FEW_WORDS) & (lacking(codes, sizes, len(a)) <= limits))  # most pairs are told apart by their words alone
    if len(at):
        words = as_chars(codes, first)
        out[at] = _widening([words[i] for i in at], [words[len(a) + i] for i in at], limits[at]) / limits[at]
    return out


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that is judged: id, dk (the document's key), pos (from 0), line, h and h2 (hashes of the line)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), doc_key(id_col, text_col).alias("dk"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(SPACE))
    rows = rows.where(F.length("raw") >= min_chars).withColumn("line", line).where(F.length("line") >= min_chars)
    return rows.select("id", "dk", "pos", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"))


def _file(file, part: int = 0, parts: int = 1):
    """(bucket, id), and the SPOT if there is one, of the buckets that fall to one of so many parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filed: set[int] = set()
        for b in batches:
            b = b.drop_duplicates("h")
            new = set(b["h"].tolist()) - filed
            b = b[b["h"].isin(new)] if len(new) < len(b) else b
            if len(filed) >= FILED:
                filed.clear()
            filed |= new
            lines, h = b["line"].tolist(), b["h"].to_numpy()
            for at, end in chunks(lines):
                keys, owner, *spot = file(lines[at:end])
                if parts > 1:
                    own = keys % np.uint64(parts) == part
                    keys, owner, spot = keys[own], owner[own], [x[own] for x in spot]
                yield pd.DataFrame({"bucket": keys.view(np.int64), "id": h[at:end][owner]} | {c: x[:, i] for x in spot for i, c in enumerate(SPOT)})

    return run


def _count_runs(every: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            lines = b.drop_duplicates("h")["line"].tolist()
            for at, end in chunks(lines):
                counts += np.bincount(slots(long_runs(*word_hashes(lines[at:end]), every)[0]), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at, "n": counts[at]})

    return run


def run_levels(lines: DataFrame, every: int) -> np.ndarray:
    """How often runs of all lines (h, line) fall into each slot, on a scale of eighths of powers of two: SLOTS bytes, whatever the corpus."""
    counted = lines.mapInPandas(_count_runs(every), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    levels = np.zeros(SLOTS, np.uint8)
    levels[counted["slot"].to_numpy(np.int64)] = np.minimum(255, 8 * np.log2(1 + counted["n"].to_numpy(np.float64))).astype(np.uint8)
    return levels


def char_distances(a: list[str], b: list[str], edits: int = EDITS, near: int = NEAR_CHARS) -> np.ndarray:
    """Edits of each pair of lines as a share of how many may be; over 1 where they are not alike."""
    n = np.minimum(np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b)))
    return edit_distances(a, b, edits) / np.maximum(0.1, allowed(n, edits, near))


def _verify(edits: int, near: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "d": char_distances(b["ta"].tolist(), b["tb"].tolist(), edits, near)})

    return run


def _verify_words(every: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ta, tb = b["ta"].tolist(), b["tb"].tolist()
            for at, end in chunks([x + y for x, y in zip(ta, tb, strict=True)]):
                yield pd.DataFrame({"a": b["a"].iloc[at:end], "b": b["b"].iloc[at:end], "d": word_distances(ta[at:end], tb[at:end], every)})

    return run


def grams(text: str) -> np.ndarray:
    """Runs of GRAM characters of a line as sorted distinct hashes, equal ones told apart by number."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return numbered(shingles(mix(chars + np.uint64(1)), GRAM))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes as sorted distinct ones, equal ones told apart by number."""
    runs = np.sort(hashes)
    first = np.ones(len(runs), bool)
    first[1:] = runs[1:] != runs[:-1]
    number = np.arange(len(runs)) - np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
    return np.sort(mix(runs + number.astype(np.uint64) * np.uint64(_BASE)))


#: What links.by_sets takes of a line.
SETS = "leader long, id long, n long, o double, cells array<double>, rest array<long>, lacks double"


def shares(need: Column, light: bool) -> Column:
    """Whether x and y of links.by_sets may share so many elements."""
    outside = F.least("xh", "h") + (F.least("xt", "t") if light else F.lit(0.0))
    return links.shared_mass("xcells", "cells") + outside >= need


def apart(bag: str, most: Column) -> Column:
    """Whether at most so many of the one's counts by cell are in excess of the other's, either way."""
    beyond = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda s, v: s + v) <= most
    return beyond(f"x{bag}", bag) & beyond(bag, f"x{bag}")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for leader, own, ta, tb in zip(b["a"].tolist(), b["b"].tolist(), b["ta"], b["tb"], strict=True):
            g = grams(tb)
            chars = np.frombuffer(tb.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            bag = [np.bincount((x % np.uint64(links.CELLS)).astype(np.int64), minlength=links.CELLS) for x in (chars, shingles(chars, 2))]
            out.append((leader, own, *links.against(g, grams(ta)), *bag))
        yield pd.DataFrame(out, columns=["leader", "id", "n", "o", "cells", "rest", "lacks", "chars", "twos"])


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ta, tb, out = b["ta"].tolist(), b["tb"].tolist(), []
        for at, end in chunks([x + y for x, y in zip(ta, tb, strict=True)]):
            hashes, first = word_hashes(ta[at:end] + tb[at:end])
            for i, (leader, own) in enumerate(zip(b["a"].iloc[at:end].tolist(), b["b"].iloc[at:end].tolist(), strict=True)):
                lead, g = (numbered(hashes[first[k] : first[k + 1]]) for k in (i, end - at + i))
                out.append((leader, own, *links.against(g, lead)))
        yield pd.DataFrame(out, columns=["leader", "id", "n", "o", "cells", "rest", "lacks"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, edits: int = EDITS, every: int | None = None) -> DataFrame:
    """A row for each document that loses lines: dk (see doc_key), removed: the lines' places and, for each, where its class's first line is. every: one word in so many may be edited; None compares characters alone."""
    lines = cut(lines_of(spread(docs.select(id_col, text_col)), id_col, text_col, min_chars), "lines", "zstd" if every else "snappy")  # texts are split once
    scratch = [lines]
    near = lines.where(F.length("line") >= near_chars).select("h", "line")

    def filed(rows: DataFrame, file, parts: int, spot: tuple[str, ...] = ()) -> list[DataFrame]:
        return [rows.mapInPandas(_file(file, part, parts), ", ".join(["bucket long", "id long", *(f"{c} short" for c in spot)])) for part in range(parts)]

    def with_texts(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "line-pairs")
        release(*scratch[1:])  # texts of former pairs; what came of them has been written by now
        del scratch[1:]
        if every:
            tidy(pairs.sparkSession)
        needed = cut(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct(), "line-needed")
        texts = cut(links.restrict(lines.select("h", "line"), needed, "h").groupBy("h").agg(F.first("line").alias("line")), "line-texts")
        scratch.append(texts)
        tasks = min(pairs.sparkSession.sparkContext.defaultParallelism, 1 + pairs.count() // PAIRS)
        if pairs.rdd.getNumPartitions() < tasks:  # a small file of ids is much work for one task
            pairs = pairs.repartition(tasks)
        return pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("tb")), "b")

    def distances(pairs: DataFrame) -> DataFrame:
        return with_texts(pairs).mapInPandas(_verify(edits, near_chars), "a long, b long, d double")

    def open_pairs(told: DataFrame) -> DataFrame:
        sets = with_texts(told.select(F.col("leader").alias("a"), F.col("id").alias("b")))
        may = lambda n: F.least(F.lit(edits), F.floor((n + GRAM - 1) / near_chars))  # noqa: E731  a line has so many characters more than runs
        sets = sets.mapInPandas(_sets, f"{SETS}, chars array<int>, twos array<int>").withColumn("slack", (may(F.col("n")) * GRAM).cast("double"))
        xn, both = F.col("xn"), may(F.least("xn", "n"))
        alike = apart("chars", both) & apart("twos", 2 * both)
        return links.by_sets(told, sets, lambda light: shares(F.greatest("xn", "n") - both * GRAM, light) & alike, "line-sets", ("n", "chars", "twos"), (xn - may(xn), xn + may(xn)))

    def word_open_pairs(told: DataFrame) -> DataFrame:
        sets = with_texts(told.select(F.col("leader").alias("a"), F.col("id").alias("b")))
        limit = lambda m: F.greatest(F.lit(1).cast("long"), F.floor(m / every))
        sets = sets.mapInPandas(_word_sets, SETS).withColumn("slack", limit(F.col("n")).cast("double"))
        xn = F.col("xn")
        return links.by_sets(told, sets, lambda light: shares(F.greatest("xn", "n") - limit(F.least("xn", "n")), light), "word-sets", ("n",), (xn - limit(xn), xn + limit(xn)))

    members = filed(near, lambda x: char_buckets(x, edits, near_chars), CHAR_PARTS if every else 1)
    labels, _ = links.classes(members, distances, 1 + 1e-9, "lines", open_pairs)
    if every:
        tidy(docs.sparkSession)
        worded = near.where(F.length("line") >= WORD_CHARS)
        levels = run_levels(worded, every)
        members = filed(worded, lambda x: placed_word_buckets(x, every, levels), WORD_PARTS, SPOT)
        reach = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / every))
        by_words, _ = links.classes(members, lambda pairs: with_texts(pairs).mapInPandas(_verify_words(every), "a long, b long, d double"), 1 + 1e-9, "words", word_open_pairs, reach)
        tidy(docs.sparkSession)
        labels = links.components(labels.union(by_words).select(F.col("id").alias("a"), F.col("label").alias("b")))
    labels = small(cut(labels, "line-labels"), FEW)
    found = lines.drop("line").join(labels.withColumnRenamed("id", "h"), "h", "left")
    found = found.select("id", "dk", "pos", F.coalesce("label", "h").alias("c"), F.when(F.col("label").isNull(), F.col("h2")).otherwise(0).alias("c2"))
    found = cut(found, "line-places")
    release(*scratch)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "dk", "pos")
    first = found.groupBy("c", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    repeated = found.join(small(cut(first, "line-firsts"), FEW), ["c", "c2"]).where(place != F.col("first"))
    one = F.struct("pos", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    return repeated.groupBy("dk").agg(F.sort_array(F.collect_set(one)).alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: str | None = None, **options) -> DataFrame:
    """docs with repeated lines taken out of their texts. report: name for a column with what removals() says, null where nothing went."""
    gone = cut(removals(docs, id_col, text_col, **options), "removals").withColumnsRenamed({"dk": "__dk", "removed": "__removed"})
    joined = docs.withColumn("__key", doc_key(id_col, text_col)).join(gone, F.col("__key") == F.col("__dk"), "left")
    lines = F.split(text_col, "\n")
    # a flag for each line: runs of lines that stay, each with one that goes behind it; linear in the lines
    ends, begins = F.concat("__removed.pos", F.array(F.size(lines))), F.concat(F.array(F.lit(-1)), "__removed.pos")
    flags = F.flatten(F.transform(F.zip_with(begins, ends, lambda a, b: b - a - 1), lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)))))
    stays = F.array_join(F.zip_with(lines, flags, lambda x, stay: F.when(stay, x)), "\n")  # leaves nulls out
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(stays)
    out = joined.withColumn(text_col, text)
    if report:
        out = out.withColumn(report, F.col("__removed"))
    return out.drop("__key", "__dk", "__removed")
