"""MinHash near-dedup by ProbMinHash.

A text is a weighted set of shingles, runs of five words, each with its number of occurrences as its weight. Texts are
compared by the probability Jaccard similarity J_P of these sets: the sum over common shingles i of
1 / (sum over all j of max(x_j / x_i, y_j / y_i)); where no shingle repeats it is the plain Jaccard similarity.

A signature estimates J_P: each shingle is a Poisson process whose rate is its weight, an arrival hits one of the
signature's registers, and a register keeps the shingle that hit it first. All arrivals come from hashes of the shingle,
so equal shingles of two texts hit alike. Generation ends early: arrivals are made up to a time by which all registers
are expected to be hit, and once they are, no later arrival can matter; texts that still have an empty register go on to
twice the time.

Signatures are cut into bands; texts alike in a band share a bucket. With 24 bands of 4 registers, a pair at 0.8 shares
no bucket with a probability of 3 in a million. Candidates are verified on their whole texts: a link is a J_P of 0.8 or
more. Classes are the components of the links (see links.py: no pair that shares a bucket is lost, and no bucket's pairs
are all made).

Step 2 there rests on a bound. Let the common shingles hold the shares p and q of the two texts' weights. The term of i
is at most f(x_i / |x|, y_i / |y|) with f(u, v) = u v / max(v + (1 - q) u, u + (1 - p) v), which is concave and
homogeneous; so J_P is at most the sum of f over the cells of any partition of the shingles, taken with the weights of
whole cells, and with one cell at most 1 / (1/p + 1/q - 1). For J_P >= 0.8 both shares are 0.8 at least, so no more than
0.2 of a text's weight comes before the first common shingle in any order, which is prefix filtering for weights. Cells
are stretches of the leader's text: an edit empties part of one, a cut text all from some cell on.

Texts with the same words in the same order are one item from the start, so exact copies cost a count.

Defined results: a text of 1 to 4 words is one shingle; a null text or one without words is in no group and stays; the
least id of a group stays, and rows alike in id and words stay or go together; a null id stays only if its group has no
other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from .common import cut, release, small, spread
from .tokens import chunks, mix, shingles, words

SIZE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Pairs of one leader that are verified together; a leader with more is dealt to several tasks.
PAIRS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted(hashes: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes and their counts."""
    if not len(hashes):
        return hashes, np.zeros(0)
    keys, counts = np.unique(shingles(hashes, min(size, len(hashes))), return_counts=True)
    return keys, counts.astype(np.float64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / (sum over all j of max(x_j / x_i, y_j / y_i))."""
    (kx, wx), (ky, wy) = x, y
    if not len(kx) or not len(ky):
        return 0.0
    at = np.searchsorted(kx, ky)
    common = kx[np.minimum(at, len(kx) - 1)] == ky
    ci, xi, yi = np.flatnonzero(common), wx[at[common]], wy[common]
    if not len(ci):
        return 0.0
    order = np.argsort(yi / xi, kind="stable")
    xi, yi = xi[order], yi[order]
    ratio = yi / xi
    only_x, only_y = wx.sum() - xi.sum(), wy.sum() - yi.sum()  # these have the ratios 0 and infinity
    upto = np.searchsorted(ratio, ratio, side="right")
    below_x = np.concatenate([[0], np.cumsum(xi)])[upto]
    above_y = yi.sum() - np.concatenate([[0], np.cumsum(yi)])[upto]
    return float((1 / ((only_x + below_x) / xi + (only_y + above_y) / yi)).sum())


def signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The shingle in each register for n texts; shingle j of the batch is owned by text owner[j], and every text has one."""
    least = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    rate = np.bincount(owner, weights, n)
    limit = registers * (np.log(registers) + 5) / rate
    todo = np.ones(n, bool)
    while todo.any():
        own = np.flatnonzero(todo[owner])
        time, step = np.zeros(len(own)), 0
        while len(own):
            step += 1
            h = mix(keys[own] + np.uint64(step * int(_GOLDEN) % 2**64))
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[own]
            stay = time <= limit[owner[own]]
            own, time, h = own[stay], time[stay], h[stay]
            slot = owner[own] * registers + (mix(h ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(least, slot, time)
            won = least[slot] == time
            held[slot[won]] = keys[own[won]]
        todo &= np.isinf(least.reshape(n, registers)).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    return held.reshape(n, registers)


def _batch(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a run of texts: distinct shingles, their counts and owners; each text's words; its number as an item."""
    hashes, first, _, _ = words(texts)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], n_words)
    powers = np.full(int(n_words.max(initial=0)) + 1, _GOLDEN)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    items = np.zeros(len(texts), np.uint64)
    np.add.at(items, owner, hashes * powers[place])
    items = mix(items + n_words.astype(np.uint64)).view(np.int64)
    whole = shingles(hashes, size) if len(hashes) >= size else np.zeros(0, np.uint64)
    inside = place[: len(whole)] + size <= n_words[owner[: len(whole)]]
    keys, owners = whole[inside], owner[: len(whole)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        keys = np.concatenate([keys, *(shingles(hashes[first[i] : first[i + 1]], n_words[i]) for i in short)])
        owners = np.concatenate([owners, short])
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], np.diff(np.flatnonzero(new), append=len(keys)).astype(np.float64), owners[new], n_words, items


def band_keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each band of each signature."""
    out = np.zeros((len(held), bands), np.uint64)
    for r in range(rows):
        out = mix(out * _GOLDEN + held.reshape(len(held), bands, rows)[:, :, r])
    return mix(out + np.arange(bands, dtype=np.uint64) * _GOLDEN).view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for at, end in chunks(texts):
                keys, counts, owner, n_words, items = _batch(texts[at:end], size)
                has = n_words > 0
                rank = np.cumsum(has) - 1
                buckets = band_keys(signatures(keys, counts, rank[owner], int(has.sum()), bands * rows), bands, rows)
                own = b.iloc[at:end]
                yield pd.DataFrame(
                    {
                        "id": pd.arrays.IntegerArray(own["id"].to_numpy(), own["none"].to_numpy()),
                        "th": own["th"],
                        "item": pd.arrays.IntegerArray(items, ~has),
                        "buckets": [buckets[r] if h else None for r, h in zip(rank, has, strict=True)],
                    }
                )

    return run


def masses(own: tuple[np.ndarray, np.ndarray], lead: tuple[np.ndarray, np.ndarray], cell: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """A weighted set against its leader's, in shares of its weight: o, cells, rest, mass and lacks of links.by_sets. cell: of each of the leader's elements."""
    keys, weights = own
    weights = weights / weights.sum()
    at = np.minimum(np.searchsorted(lead[0], keys), len(lead[0]) - 1)
    shared = lead[0][at] == keys
    cells = np.bincount(cell[at[shared]], weights[shared], links.CELLS)
    return float(weights[shared].sum()), cells, keys[~shared].view(np.int64), weights[~shared], float(weights[~shared].sum())


def cells_of(hashes: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """The cell of each distinct shingle of a text: which stretch of the text it comes first in."""
    runs = shingles(hashes, min(size, len(hashes)))
    first = np.unique(runs, return_index=True)[1]
    return first * links.CELLS // len(runs)


def fits(threshold: float):
    """The bound on J_P of x and y over the cells, for links.by_sets."""
    need = threshold - 1e-9

    def f(u, v, p, q):
        return u * v / (F.greatest(v + (1 - q) * u, u + (1 - p) * v) + 1e-300)

    def fit(light: bool):
        p, q = F.col("xo") + F.col("xh"), F.col("o") + F.col("h")
        if light:
            p, q = p + F.col("xt"), q + F.col("t")
        p, q = F.least(p, F.lit(1.0)), F.least(q, F.lit(1.0))
        whole = 1 / (1 / p + 1 / q - 1)
        outside = f(F.col("xh"), F.col("h"), p, q) + (f(F.col("xt"), F.col("t"), p, q) if light else 0.0)
        within = F.aggregate(F.zip_with("xcells", "cells", lambda u, v: f(u, v, p, q)), F.lit(0.0), lambda s, v: s + v)
        return (whole >= need) & (within + outside >= need)

    return fit


def _against_leader(size: int, details: bool):
    """For rows sorted by (a, salt), the leader's text first: a, b, d; or what step 2 needs of b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lead, cell = None, None, None
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            a_ids, b_ids, is_lead = batch["a"].tolist(), batch["b"].tolist(), batch["lead"].tolist()
            for at, end in chunks(texts):
                hashes, first, _, _ = words(texts[at:end])
                for i in range(at, end):
                    own_words = hashes[first[i - at] : first[i - at + 1]]
                    own = weighted(own_words, size)
                    if is_lead[i]:
                        now, lead = a_ids[i], own
                        cell = cells_of(own_words, own[0], size) if details else None
                        continue
                    if a_ids[i] != now:
                        raise ValueError(f"no text for leader {a_ids[i]}")
                    out.append((now, b_ids[i], *masses(own, lead, cell)) if details else (now, b_ids[i], 1 - probability_jaccard(lead, own)))
            yield pd.DataFrame(out, columns=["a", "b", "o", "cells", "rest", "mass", "lacks"] if details else ["a", "b", "d"])

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs: id_col, th (hash of its text), class_id (least id of its group), class_size (rows), kept."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).withColumn("th", F.xxhash64("text"))
    filled = source.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "th", "text")  # pandas has no null integers
    signed = cut(filled.mapInPandas(_sign(size, bands, rows), "id long, th long, item long, buckets array<long>"), "signatures")
    items = signed.where("item is not null").groupBy("item").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("th").alias("th"), F.first("buckets").alias("buckets"))
    items = cut(items, "items")
    members = items.select(F.explode("buckets").alias("bucket"), F.col("item").alias("id"))

    scratch: list[DataFrame] = []

    def against_leader(pairs: DataFrame, details: bool) -> DataFrame:
        pairs = cut(pairs, "pairs")
        needed = pairs.select(F.col("a").alias("item")).union(pairs.select(F.col("b").alias("item"))).distinct()
        wanted = cut(items.select("item", "th").join(needed, "item"), "wanted")
        texts = source.select("th", "text").join(small(wanted), "th").groupBy("item").agg(F.first("text").alias("text"))
        texts = cut(texts, "texts")
        scratch.append(texts)
        many = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("salts")).where("salts > 1"), "many")
        salted = pairs.join(small(many), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))).drop("salts")
        leads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("item", "a"), "a").select("a", "salt", F.lit(0).cast("long").alias("b"), F.lit(True).alias("lead"), "text")
        others = salted.join(texts.withColumnRenamed("item", "b"), "b").select("a", "salt", "b", F.lit(False).alias("lead"), "text")
        dealt = leads.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"))
        schema = "a long, b long, o double, cells array<double>, rest array<long>, mass array<double>, lacks double" if details else "a long, b long, d double"
        return dealt.mapInPandas(_against_leader(size, details), schema)

    def open_pairs(told: DataFrame) -> DataFrame:
        sets = against_leader(told.select(F.col("leader").alias("a"), F.col("id").alias("b")), True).withColumnsRenamed({"a": "leader", "b": "id"})
        return links.by_sets(told, sets.withColumn("slack", F.lit(1 - threshold + 1e-9)), fits(threshold), "against-leaders")

    labels, _ = links.classes(members, lambda pairs: against_leader(pairs, False), 1 - threshold + 1e-9, "minhash", open_pairs)
    release(*scratch)
    labelled = items.select("item", "least", "n").join(labels.withColumnRenamed("id", "item"), "item", "left").withColumn("label", F.coalesce("label", "item"))
    whole = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_item = cut(labelled.select("item", "label").join(whole, "label").select("item", "class_id", "class_size"), "classes")
    out = signed.select("id", "th", "item").join(of_item, "item", "left")
    none = F.col("item").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "th",
        F.when(none, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (none | F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that go; columns as they are."""
    gone = cut(groups(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("th").alias("__th")).distinct(), "gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__th"))
    return docs.join(small(gone), same, "left_anti")
