"""Quality classifier: random-indexing word vectors and a two-layer network (operator 8)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks
from .quality_rules import HELD_OUT, fold, labelled_sample, sample_rows, sigmoid
from .textscan import mix, owners, span_hashes, spans

#: Labelled rows that vectors and network are fitted on, at most.
SAMPLE_ROWS = 3_000
#: Log2 of the number of hashed words, the vectors' width, and the entries of an index vector that aren't 0.
WORD_BITS, WIDTH, ENTRIES = 15, 32, 4
#: Words to each side that make a word's context.
CONTEXT = 2
HIDDEN = 32
#: A document counts as good from this score on.
GOOD_AT = 0.7
_STEP_BYTES = 1 << 17

# Runs of letters and digits (all bytes beyond ASCII among them) and runs of punctuation are
# words of their own, so that junk glued to a word shows as a word.
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed word, first word of each text)."""
    kind = _KIND[data]
    starts, ends = [], []
    for k in (1, 2):
        s, e = spans(kind == k, bounds)
        starts.append(s)
        ends.append(e)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    hashed = (span_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    return hashed, np.searchsorted(starts, bounds)


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each hashed word, drawn from its number alone."""
    count = 1 << WORD_BITS
    out = np.zeros((count, WIDTH), np.float32)
    for entry in range(ENTRIES):
        draw = mix(np.arange(count, dtype=np.uint64) * np.uint64(ENTRIES) + np.uint64(entry + 1))
        np.add.at(out, (np.arange(count), (draw % np.uint64(WIDTH)).astype(int)), np.where(draw >> np.uint64(63), 1, -1))
    return out


def word_vectors(texts: list[bytes]) -> np.ndarray:
    """Random indexing: a word's vector sums the index vectors around it, and its own direction.

    Sums are scaled to unit length and halved in weight against the index vector, so that a word
    that was never seen still has a vector of its own.
    """
    index = index_vectors()
    context = np.zeros_like(index)
    for _, _, data, bounds in chunks(pa.array(texts, pa.large_binary()), _STEP_BYTES):
        word, first = words(data, bounds)
        owner = owners(first)
        around = np.zeros((len(word), WIDTH), np.float32)
        for step in range(1, CONTEXT + 1):
            same = owner[step:] == owner[:-step]
            around[step:] += index[word[:-step]] * same[:, None]
            around[:-step] += index[word[step:]] * same[:, None]
        order = np.argsort(word, kind="stable")
        if len(order):
            heads = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) > 0]))
            context[word[order][heads]] += np.add.reduceat(around[order], heads, axis=0)
    seen = np.abs(context).sum(axis=1) > 0
    if seen.any():
        context[seen] -= context[seen].mean(axis=0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return context + index / np.sqrt(ENTRIES)


def pooled(vectors: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A text's mean word vector, the mean cosine of neighbouring words, and its share of 1s.

    The last two tell texts apart that say the same word over and over. No words: zeros.
    """
    word, first = words(data, bounds)
    out = np.zeros((len(bounds) - 1, WIDTH + 2), np.float32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        rows = vectors[word]
        heads = first[:-1][full]
        count = np.diff(first)[full]
        out[full, :WIDTH] = np.add.reduceat(rows, heads, axis=0) / count[:, None]
        norms = np.linalg.norm(vectors, axis=1) + 1e-6
        near, same = np.zeros(len(word)), np.zeros(len(word))
        near[:-1] = np.einsum("ij,ij->i", rows[:-1], rows[1:]) / (norms[word[:-1]] * norms[word[1:]])
        same[:-1] = word[:-1] == word[1:]
        last = first[1:][full] - 1
        near[last] = same[last] = 0  # the last word of a text has no next one
        for column, value in ((WIDTH, near), (WIDTH + 1, same)):
            out[full, column] = np.add.reduceat(value, heads) / np.maximum(count - 1, 1)
    return out


class Network:
    """Two layers: tanh units, then one logit; the logit is divided by a fitted temperature."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float) -> None:
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def temperature(logit: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by so that the labels are likeliest; 1 at least, so never sharper."""
    grid = np.exp(np.linspace(0, np.log(8), 60))
    loss = [-np.mean(np.where(labels == 1, np.log(sigmoid(logit / t) + 1e-12), np.log(sigmoid(-logit / t) + 1e-12))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_network(x: np.ndarray, labels: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature comes from the rest."""
    draw = np.random.default_rng(seed)
    held = np.arange(len(labels)) % 5 == 4
    if not 0 < labels[held].sum() < held.sum():
        held[:] = False
    train_x, train_y = x[~held], labels[~held].astype(float)
    mean, scale = train_x.mean(axis=0), train_x.std(axis=0) + 1e-3
    layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    z = (train_x - mean) / scale
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(z))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            hidden = np.tanh(z[rows] @ layers[0] + layers[1])
            error = (sigmoid(hidden @ layers[2] + layers[3][0]) - train_y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            gradients = [z[rows].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(layers, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, layers, 1.0)
    if held.any():
        net.temperature = temperature(net.logit(x[held]), labels[held])
    return net


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, Network]:
    """Word vectors and network of labelled texts; without any, every score is a half."""
    vectors = word_vectors(texts).astype(np.float16)
    if len(texts):
        x = np.concatenate([pooled(vectors.astype(np.float32), d, b) for *_, d, b in chunks(pa.array(texts, pa.large_binary()), _STEP_BYTES)])
        return vectors, fit_network(x, labels)
    width = WIDTH + 2
    return vectors, Network(np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], 1.0)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sample_rows(batches)
    vectors, net = fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.int64))
    model = pickle.dumps((vectors, net.mean, net.scale, net.layers, net.temperature))
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors and network, fitted by one task on the bounded sample."""
    sample = labelled_sample(docs, labels, label_col, most)
    rows = arrow_map(sample, _fit_task, "model binary").collect()
    if not rows:
        return fit([], np.zeros(0, np.int64))
    vectors, *rest = pickle.loads(bytes(rows[0]["model"]))
    return vectors, Network(*rest)


def _score(vectors: np.ndarray, net: Network, good_at: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = vectors.astype(np.float32)
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(2), _STEP_BYTES):
                scores = net.score(pooled(wide, data, bounds)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(scores), pa.array((scores >= good_at).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return score


def classify(docs: DataFrame, labels: DataFrame, good_at: float = GOOD_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    The score is the calibrated probability that the label is 1, from the whole text alone. A
    text without words, null among them, has the score of an all-zero pool. Labels that are null
    or of ids without a document teach nothing; without any label every score is 0.5. Vectors
    and network learn from at most SAMPLE_ROWS labelled rows (SAMPLE_BYTES bytes) outside the held-out fold. A null
    id is not held out. Repeated rows repeat their result. Other columns are not read. An empty
    table gives an empty result.
    """
    vectors, net = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    held = F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).alias("text"))
    return arrow_map(rows, _score(vectors, net, good_at), "doc_id long, held_out boolean, score double, predicted int")
