"""Language ID by a byte convolutional network.

Text is UTF-8 bytes, cut into windows of a fixed length (the last is padded); every byte of every text is in one. Bytes
are embedded, filters of several widths run over the window, each filter is max-pooled over it, and a softmax layer
makes the languages' probabilities. A text's score is the mean over its windows, weighted by their bytes.

The network is trained here, in numpy, on a bounded sample of labelled rows: at most `PER_LANGUAGE` texts of a language
(those with the smallest hash of their id), fewer if there are so many languages that they would be over `TEXTS` in all,
and `WINDOWS` windows of a text, which are cut out where the texts are. These bounds hold for training alone; every label
is learned, and predictions cover all rows and whole texts. At prediction the embedding and a filter's
weight at one place are multiplied beforehand into a table by byte, so that a filter is a sum of table rows.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if no row is labelled;
ties go to the first language in order; repeated rows get the same result; an empty table gives an empty one. Only the
text is looked at when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

TEXTS = 160_000
PER_LANGUAGE = 800
WINDOWS = 5
LENGTH = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS, EPOCHS, BATCH = 8, 16, 6, 64
#: A small sample is gone through more often, to this number of steps.
LEAST_STEPS = 1000
PAD = 256
_LETTER = regex.compile(r"\p{L}").search


def windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: bytes with padding, the text of each, and its bytes that are no padding."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // length)
    shift = np.cumsum(counts * length) - counts * length - (np.cumsum(sizes) - sizes)
    out = np.full(int(counts.sum()) * length, PAD, np.uint16)
    out[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)] = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out.reshape(-1, length), owner, np.minimum(length, sizes[owner] - within * length)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Net:
    labels: list[str]
    params: dict[str, np.ndarray]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, what each byte adds to each filter."""
        p = self.params
        return [[np.ascontiguousarray(p["embed"] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED]) for k in range(w)] for w in WIDTHS]

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        for w, own in zip(WIDTHS, tables, strict=True):
            n = x.shape[1] - w + 1
            z = own[0][x[:, :n]]
            for k in range(1, w):
                z += own[k][x[:, k : k + n]]
            pooled.append(np.maximum(z.max(axis=1) + self.params[f"b{w}"], 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.params["dense"] + self.params["bias"])


def train(picked: list[bytes], labels: list[str], seed: int = 5) -> Net:
    """Fits the network by Adam on windows of at most LENGTH bytes and the label of each."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    number = {k: i for i, k in enumerate(names)}
    x, target = windows(picked)[0], np.array([number[k] for k in labels], np.int64)
    p = {"embed": rng.normal(0, 0.3, (257, EMBED)), "dense": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))), "bias": np.zeros(len(names))}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    net = Net(names, p)
    per_epoch = -(-len(x) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, per_epoch))) if len(names) > 1 else 0
    steps = epochs * per_epoch
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            seen = x[own]
            short = rng.integers(32, 2 * LENGTH, len(own))  # half of the windows are cut, as short texts are
            seen[np.arange(LENGTH) >= short[:, None]] = PAD
            grads = _gradients(net, seen, target[own])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] -= 0.01 * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


def _gradients(net: Net, x: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    p, n = net.params, len(x)
    embedded = p["embed"][x]
    pooled, places = [], []
    for w in WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).swapaxes(2, 3).reshape(n, x.shape[1] - w + 1, w * EMBED)
        z = view @ p[f"w{w}"] + p[f"b{w}"]
        best = z.argmax(axis=1)
        pooled.append(np.take_along_axis(z, best[:, None, :], axis=1)[:, 0])
        places.append((view, best))
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    error = softmax(hidden @ p["dense"] + p["bias"])
    error[np.arange(n), target] -= 1
    error /= n
    grads = {"dense": hidden.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    back = (error @ p["dense"].T) * (hidden > 0)
    for j, w in enumerate(WIDTHS):
        view, best = places[j]
        g = back[:, j * FILTERS : (j + 1) * FILTERS]
        at = view[np.arange(n)[:, None], best]  # what each filter saw where it was largest
        grads[f"w{w}"] = np.einsum("nf,nfd->df", g, at)
        grads[f"b{w}"] = g.sum(axis=0)
        into = np.einsum("nf,df->nfd", g, p[f"w{w}"]).reshape(n, FILTERS, w, EMBED)
        for k in range(w):
            np.add.at(grads["embed"], x[np.arange(n)[:, None], best + k], into[:, :, k])
    return grads


def predict_texts(net: Net, tables: list, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text."""
    out = np.zeros((len(texts), len(net.labels)))
    seen = [i for i, t in enumerate(texts) if t and net.labels and _LETTER(t)]
    bodies = [texts[i].encode("utf-8", "replace") for i in seen]
    at = 0
    while at < len(seen):
        end, size = at, 0
        while end < len(seen) and (end == at or size + len(bodies[end]) < 1 << 19):
            size += len(bodies[end])
            end += 1
        x, owner, weight = windows(bodies[at:end])
        for k in range(0, len(x), 256):
            probs = net.probabilities(x[k : k + 256], tables) * weight[k : k + 256, None]
            np.add.at(out, np.array(seen)[at + owner[k : k + 256]], probs)
        at = end
    total = out.sum(axis=1)
    best = out.argmax(axis=1) if net.labels else np.zeros(len(texts), int)
    labels = [net.labels[b] if t else "und" for b, t in zip(best, total, strict=True)]
    scores = [min(1.0, float(row[b] / t)) if t else 0.0 for row, b, t in zip(out, best, total, strict=True)]
    return labels, scores


def sample(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """The bounded training sample: evenly spaced windows of texts of rows for which `learn` is true, and their labels."""
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("binary").alias("body"), F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col)), 1).alias("u")).where(F.octet_length("body") > 0)
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row for each language
    if not counts:
        return [], []
    most = max(1, min(PER_LANGUAGE, TEXTS // len(counts)))
    # about three times what is kept is let through, so that ranking sees a bounded number of rows of any label
    share = F.create_map(*(x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, 3 * most / r["n"])))))
    last = F.floor((F.octet_length("body") - 1) / LENGTH)
    places = F.array_distinct(F.transform(F.array(*map(F.lit, range(WINDOWS))), lambda j: F.floor(last * j / (WINDOWS - 1)).cast("int")))
    cut_out = F.transform(places, lambda i: F.substr("body", i * LENGTH + 1, F.lit(LENGTH)))
    ranked = rows.where(F.col("u") <= F.element_at(share, F.col("label")) * float(2**63)).select("label", "u", cut_out.alias("windows"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("u", "windows"))).where(F.col("rank") <= most)
    got = [(r["label"], bytes(w)) for r in ranked.select("label", "windows").orderBy("label", "rank").collect() for w in r["windows"]]
    return [w for _, w in got], [k for k, _ in got]


def predict(docs: DataFrame, net: Net, text_col: str = "text", label_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with the predicted label and its score. Columns called like them are replaced."""
    docs = docs.drop(label_to, score_to)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{label_to}` string", f"`{score_to}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for b in batches:
            labels, scores = predict_texts(net, tables, b.column(text_col).to_pylist())
            yield b.append_column(label_to, pa.array(labels, pa.string())).append_column(score_to, pa.array(scores, pa.float64()))

    return spread(docs).mapInArrow(run, schema)  # other columns pass as they are


def fold(id_col: str = "doc_id") -> Column:
    """The fold of a row, 0 to 2, by the CRC of its id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, **columns: str) -> Net:
    """A network that learned from the labelled rows of docs whose fold is not 1."""
    return train(*sample(docs, fold(columns.get("id_col", "doc_id")) != 1, **columns))
