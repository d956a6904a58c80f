"""Quality classifier: Naive Bayes support vectors. Indicators of word n-grams, scaled by the log-count ratio of the two
classes, under a linear hinge-loss model that dual coordinate descent fits.

A word is a run of letters, digits and bytes beyond ASCII, or a run of other signs; single words and pairs of neighbours
are hashed into BUCKETS numbers, so that the model has a fixed size however many texts there are. A word that follows
itself is one and the same pair, whatever the word. A text is the set of its
numbers, each weighted by its ratio, at length 1. Ratios come from the counts of all labelled rows outside the held-out
fold: a task adds up its own texts, Spark the tasks. The hinge-loss model is fitted on a sample of those rows, bounded by
two documented parameters, ROWS for each class and INDICATORS in all; a further quarter of the sample turns margins into a score. Whole
texts are read in windows that overlap by a word, so a very long one needs no more memory than a window.

Labels meet texts by doc_id, and only texts that have one move, if their table is too large to broadcast. Labels, language,
source and id are never inputs of a score. A row is predicted 1 from THRESHOLD on, which is below a half: a text goes
only where the model is fairly sure.

Defined results: null and empty texts have no features, and the score of the model's intercept; a null doc_id is never
learned from and not held out; labels that repeat count once, those that contradict each other or aren't 0 or 1 not at
all; with labels of one class only every text has the score of that class, and with none 0.5; rows that repeat are scored
alike and learned from as often; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, spread

BUCKETS = 1 << 18
#: Bounds of the sample that the hinge-loss model is fitted on: rows of each class, and indicators in all of them.
ROWS, INDICATORS = 8000, 6_000_000
#: Added to the counts of each class; the cost of a point on the wrong side; passes over the sample.
ALPHA, COST, EPOCHS = 1.0, 1.0, 12
THRESHOLD = 0.3
#: Bytes of text that are taken apart at once.
WINDOW = 1 << 21

_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = _KIND[127] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_MIX = np.random.default_rng(12).integers(1, 2**63, 66, dtype=np.uint64) | np.uint64(1)


def fold(id_col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[64]
    return (h ^ (h >> np.uint64(29))) * _MIX[65]


def _window(data: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted distinct doc * BUCKETS + bucket of the n-grams of bytes that belong to documents doc (ascending)."""
    kind = _KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(change)
    if not len(begin):
        return np.empty(0, np.int64)
    size = np.diff(begin, append=len(data))
    at = np.arange(len(data)) - np.repeat(begin, size)
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _MIX[at & 63], begin)
    h = _stir(h + size.astype(np.uint64) * _MIX[1])
    word = kind[begin] > 0
    h, owner = h[word], doc[begin[word]].astype(np.int64)
    two = np.where(h[:-1] == h[1:], _MIX[3], _stir(h[:-1] * _MIX[2] + h[1:]))[owner[:-1] == owner[1:]]
    grams = np.concatenate([h, two]) >> np.uint64(64 - 18)
    return np.unique(np.concatenate([owner, owner[:-1][owner[:-1] == owner[1:]]]) * BUCKETS + grams.astype(np.int64))


def _long(data: np.ndarray) -> np.ndarray:
    """Distinct buckets of one text of any length: windows that end where a word does and begin anew with their last word, for its pair with the next one."""
    seen = np.zeros(BUCKETS, bool)
    edge = lambda i: _KIND[data[i - 1]] != _KIND[data[i]]
    a, room = 0, WINDOW
    while True:
        b = min(a + room, len(data))
        while b < len(data) and not edge(b):
            b += 1
        last = b - 1
        while last > a and (_KIND[data[last]] == 0 or not edge(last)):
            last -= 1
        if last == a and b < len(data) and _KIND[data[a]]:
            room *= 2  # one word fills the window
            continue
        seen[_window(data[a:b], np.zeros(b - a, np.int32)) % BUCKETS] = True
        if b == len(data):
            return np.flatnonzero(seen)
        a, room = last if _KIND[data[last]] else b, WINDOW


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of texts: where each one's buckets end, and all their distinct buckets, ascending within a text."""
    blob = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, blob.offset * 8)
    data = np.frombuffer(blob.buffers()[2], np.uint8) if blob.buffers()[2] else np.empty(0, np.uint8)
    counts, parts, i = np.zeros(len(blob), np.int64), [], 0
    while i < len(blob):
        j = max(int(np.searchsorted(ends, ends[i] + WINDOW, "right")) - 1, i + 1)
        piece = data[ends[i] : ends[j]]
        if len(piece) > WINDOW:
            keys = _long(piece)
        else:
            keys = _window(piece, np.repeat(np.arange(j - i, dtype=np.int32), np.diff(ends[i : j + 1])))
        counts[i:j] = np.bincount(keys // BUCKETS, minlength=j - i)
        parts.append(keys % BUCKETS)
        i = j
    return np.cumsum(counts), np.concatenate(parts) if parts else np.empty(0, np.int64)


def learnable(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text, label of the rows that may be learned from: those outside the held-out fold whose label is 0 or 1."""
    one = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    one = one.where("label = most").select("doc_id", F.col("label").cast("int").alias("label")).where(fold() != 0)
    return docs.select("doc_id", F.col(text_col).cast("string").alias("text")).where(fold() != 0).join(small(one), "doc_id")


def counts(rows: DataFrame) -> np.ndarray:
    """How many texts of label 0 and of label 1 have each bucket, and in a last column how many there are: all rows count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            ends, at = features(b.column("text"))
            label = b.column("label").to_numpy(zero_copy_only=False)
            of = np.repeat(label, np.diff(ends, prepend=0))
            for y in (0, 1):
                total[y, :BUCKETS] += np.bincount(at[of == y], minlength=BUCKETS)
                total[y, BUCKETS] += int((label == y).sum())
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, total[:, at])], ["bucket", "n0", "n1"])

    out = np.zeros((2, BUCKETS + 1), np.int64)
    summed = rows.select("text", "label").mapInArrow(add, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # BUCKETS + 1 rows at most
    out[:, summed["bucket"].to_numpy()] = np.array([summed["n0"].to_numpy(), summed["n1"].to_numpy()])
    return out


def sample(rows: DataFrame, n: np.ndarray, per_class: int, indicators: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and buckets of a share of the rows, chosen by a hash of id and text: about per_class of each class and no more than that share of the indicators."""
    steps = 1 << 20
    shares = [min(1.0, per_class / max(int(n[y, BUCKETS]), 1), indicators / 2 / max(int(n[y, :BUCKETS].sum()), 1)) for y in (0, 1)]
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    chosen = rows.where(lot < F.when(F.col("label") == 1, int(shares[1] * steps)).otherwise(int(shares[0] * steps)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = features(b.column("text"))
            each = [x.astype(np.int32).tobytes() for x in np.split(at, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lot"), pa.array(each, pa.binary())], ["label", "lot", "at"])

    got = chosen.select("text", "label", F.xxhash64("text", "doc_id").alias("lot")).mapInArrow(take, "label int, lot long, at binary").toArrow()
    got = got.sort_by([("lot", "ascending"), ("at", "ascending")])
    return got["label"].to_numpy(), [np.frombuffer(x, np.int32) for x in got["at"].to_pylist()]


def ratios(n: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each bucket, p and q its smoothed counts in the texts of label 1 and 0. Each class is
    smoothed in proportion to its size, so that a bucket no text has comes to 0, however uneven the classes are."""
    n = n[:, :BUCKETS]
    size = n.sum(1, keepdims=True)
    q, p = n + alpha * 2 * size / max(size.sum(), 1)
    return np.log((p / p.sum()) / (q / q.sum())) if size.all() else np.zeros(BUCKETS)


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 12) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent: of one point at a time the best dual variable
    within [0, cost], others fixed. x: buckets and values of each row, of length 1 or 0; the intercept is a last weight
    whose value is 1."""
    w, dual = np.zeros(BUCKETS + 1), np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for _, v in x])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, v = x[i]
            slope = y[i] * (w[at] @ v + w[BUCKETS]) - 1.0
            new = min(max(dual[i] - slope / norm[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[at] += step * v
                w[BUCKETS] += step
                dual[i] = new
    return w


def _scaled(at: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[at]
    size = np.sqrt(v @ v)
    return v / size if size > 0 else v


def sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a > 0 and b of score = 1 / (1 + exp(-(a margin + b))), by Newton's steps on the weighted log-loss with a slight pull to a = 1, b = 0."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        a = max(a, 1e-3)
    return float(a), float(b)


@dataclass
class Model:
    """ratio: of each bucket; weight: of each scaled bucket; intercept of the margin; a and b of the sigmoid."""

    ratio: np.ndarray
    weight: np.ndarray
    intercept: float
    a: float
    b: float

    def score(self, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        begins = np.concatenate([[0], ends[:-1]])
        sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[np.append(begins, len(at))])
        r = self.ratio[at]
        size = np.sqrt(np.maximum(sums(r * r), 0))
        margin = np.divide(sums(r * self.weight[at]), size, out=np.zeros(len(ends)), where=size > 1e-9) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = ROWS, indicators: int = INDICATORS) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    rows = learnable(spread(docs), labels)
    n = counts(rows)
    of = n[:, BUCKETS]
    none = np.zeros(BUCKETS)
    if not of.all():
        share = 0.5 if not of.any() else float(of[1] > 0)
        return Model(none, none, 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    r = ratios(n)
    label, at = sample(rows, n, per_class, indicators)
    y = np.where(label == 1, 1.0, -1.0)
    x = [(a, _scaled(a, r)) for a in at]
    learn = np.arange(len(y)) % 4 != 3  # in order of a hash; the rest is for the sigmoid
    learn |= len(set(y[learn])) < 2 or len(set(y[~learn])) < 2
    rest = ~learn if (~learn).any() else learn
    # both classes weigh the same, however many rows each has
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    mine = np.flatnonzero(learn)
    w = descend([x[i] for i in mine], y[mine], COST * weight[mine])
    margin = np.array([w[a] @ v + w[BUCKETS] for a, v in x])
    a, b = sigmoid(margin[rest], (y[rest] > 0).astype(float), weight[rest])
    return Model(r, w[:BUCKETS], float(w[BUCKETS]), a, b)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its text alone."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = dict(rows.dtypes)["doc_id"]
    known = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each of BUCKETS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(known.value.score(*features(b.column("text"))), pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(score, f"doc_id {kind}, score double")
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
