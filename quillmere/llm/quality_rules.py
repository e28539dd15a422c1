"""Quality rules: fixed counts, then a calibrated n-gram logistic regression (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks
from .textscan import mix, owners, span_hashes, spans, sums_of, windows, word_spans

#: Labelled rows that the regression is fitted on, at most (those of the smallest id hashes), and
#: bytes of their texts: a row whose text no longer fits is passed over in the fit alone.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 64 << 20
#: Log2 of the number of hashed features; each n-gram family has a table of its own.
TABLE_BITS = 16
#: A document stays if its calibrated probability of quality is at least this.
KEEP_AT = 0.7
#: The base rules: fewer words, or a larger share of repeated words (in per cent), fail.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
HELD_OUT, FOLDS = 2, 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FAMILIES = 3  # words, word pairs, character trigrams


def fold(id_col: str = "doc_id"):
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    starts, ends, first = word_spans(data, bounds)
    n_words = np.diff(first)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = sums_of(begins[ends] - begins[starts], first)
    n_symbols = sums_of(_SYMBOL[data].astype(np.int64), bounds)

    line_starts, line_ends = spans(data != 10, bounds)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_first = np.searchsorted(line_starts, bounds)
    repeated, _ = _repeats(span_hashes(data, line_starts, line_ends), owners(line_first))
    n_dup_lines = sums_of(repeated.astype(np.int64), line_first)

    joined, at = windows(span_hashes(data, starts, ends), first, WINDOW)
    _, twice = _repeats(joined, owners(np.searchsorted(at, first)))
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + WINDOW, -1)
    n_repeat_words = sums_of((np.cumsum(edges[:-1]) > 0).astype(np.int64), first)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is it equal to an earlier one of its owner; is there another equal one at all."""
    later, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return later, twice


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each code point, each text's first one); data is UTF-8."""
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    value = data[at].astype(np.uint64)
    if len(at) < len(data):  # some code points have more than one byte
        follows = np.concatenate([~begins, np.zeros(3, bool)])
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        more = np.ones(len(at), bool)
        for step in (1, 2, 3):
            more &= follows[at + step]
            value |= np.where(more, padded[at + step], 0).astype(np.uint64) << np.uint64(8 * step)
    return value * np.uint64(0x9E3779B97F4A7C15), np.searchsorted(at, bounds)


def features(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed index, first index of each text) of each family of n-grams."""
    starts, ends, first = word_spans(data, bounds)
    hashes = span_hashes(data, starts, ends)
    shift = np.uint64(64 - TABLE_BITS)
    pairs, at = windows(hashes, first, 2)
    letters, letter_first = characters(data, bounds)
    grams, gram_at = windows(letters, letter_first, 3)
    return [
        ((hashes >> shift).astype(np.int32), first),
        ((pairs >> shift).astype(np.int32), np.searchsorted(at, first)),
        ((grams >> shift).astype(np.int32), np.searchsorted(gram_at, letter_first)),
    ]


def logits(weights: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum over families of the mean weight of a text's n-grams, and the bias.

    weights: one table for each family, then the bias and Platt's two numbers.
    """
    total = np.full(len(bounds) - 1, weights[-3])
    for family, (index, first) in enumerate(features(data, bounds)):
        table = weights[family << TABLE_BITS : (family + 1) << TABLE_BITS]
        total += sums_of(table[index], first) / np.maximum(np.diff(first), 1)
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 120, rate: float = 2.0, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression (Adagrad over all rows), calibrated on every fifth row."""
    size = _FAMILIES << TABLE_BITS
    weights = np.zeros(size + 3)
    weights[-2] = 1.0
    if not len(labels):
        weights[-3] = 30.0  # nothing learnt: nothing rejected
        return weights
    rows, columns, values = [], [], []
    for start, _, data, bounds in chunks(pa.array(texts, pa.large_binary())):
        for family, (index, first) in enumerate(features(data, bounds)):
            keys, counts = np.unique((owners(first) << TABLE_BITS) + index, return_counts=True)
            row = keys >> TABLE_BITS
            rows.append((row + start).astype(np.int32))
            columns.append(((keys & ((1 << TABLE_BITS) - 1)) + (family << TABLE_BITS)).astype(np.int32))
            values.append((counts / np.maximum(np.diff(first), 1)[row]).astype(np.float32))
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    held = np.arange(len(labels)) % 5 == 4
    fitting = ~held if 0 < labels[held].sum() < held.sum() else np.ones(len(labels), bool)
    share = np.bincount(labels[fitting].astype(int), minlength=2) / fitting.sum()
    each = fitting / fitting.sum()
    squares = np.full(size, 1e-8)
    bias_squares = 1e-8
    weights[-3] = np.log((share[1] + 1e-3) / (share[0] + 1e-3))
    for _ in range(steps):
        z = np.bincount(row, value * weights[column], len(labels)) + weights[-3]
        error = (sigmoid(z) - labels) * each
        gradient = np.bincount(column, value * error[row], size) + penalty * weights[:size]
        squares += gradient**2
        weights[:size] -= rate * gradient / np.sqrt(squares)
        bias_squares += error.sum() ** 2
        weights[-3] -= 0.1 * error.sum() / np.sqrt(bias_squares)
    z = np.bincount(row, value * weights[column], len(labels)) + weights[-3]
    weights[-2:] = platt(z[held], labels[held]) if held.any() and 0 < labels[held].sum() < held.sum() else (1.0, 0.0)
    return weights


def platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the sigmoid that fits the labels best, by damped Newton steps.

    Targets are smoothed as Platt does, so that separable scores stay finite.
    """
    good = labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -5, 5))
    return (a, b) if a > 0 else (1.0, 0.0)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sample_rows(batches)
    weights = fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["weights"])


def sample_rows(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    """The sample's rows in order of id, as far as SAMPLE_BYTES of text go; rows come by id hash."""
    rows, room = [], SAMPLE_BYTES
    for batch in batches:
        for at in range(0, len(batch), 64):
            for row in batch.slice(at, 64).to_pylist():
                if len(row["text"]) <= room:
                    room -= len(row["text"])
                    rows.append(row)
    return sorted(rows, key=lambda r: r["doc_id"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): at most `most` labelled rows outside the held-out fold.

    Rows are chosen by a hash of the id, so the sample neither follows the order of ids nor needs
    more than the ids to choose. It holds one row for each id: of an id's texts, the one with
    the least hash. One partition, in order of the hash.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != HELD_OUT))
        .select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers at the most
    one = known.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return one.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE_ROWS) -> np.ndarray:
    """The regression's numbers, fitted by one task on the bounded sample."""
    sample = labelled_sample(docs, labels, label_col, most)
    rows = arrow_map(sample, _fit_task, "weights binary").collect()
    return np.frombuffer(rows[0]["weights"], "<f4") if rows else fit([], np.zeros(0, np.int64)).astype("<f4")


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in _OUT)}, base_failed boolean, kept boolean, probability double"


def _judge(weights: np.ndarray, keep_at: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                counts = base_counts(data, bounds)
                words = counts["n_words"]
                failed = (words < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * words)
                chance = sigmoid(weights[-2] * logits(weights, data, bounds) + weights[-1]).astype(np.float64)
                arrays = [batch.column(0).slice(row, end - row), *(pa.array(counts[c].astype(np.int64)) for c in _OUT)]
                arrays += [pa.array(failed), pa.array(~failed & (chance >= keep_at)), pa.array(chance)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_OUT, "base_failed", "kept", "probability"])

    return judge


def judge(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the base counts, base_failed, kept, and the probability.

    Null counts as empty: no words, so the base rules reject it. Labels that are null or of ids
    without a document teach nothing; without any label the base rules alone decide. The
    regression learns from at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes, none of them in the held-out fold, but
    every document is judged by its whole text. Rows are judged one by one, so repeated rows and
    null ids make no difference. Other columns are not read. An empty table gives an empty result.
    """
    weights = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, _judge(weights, keep_at), _SCHEMA)


def _passing(weights: np.ndarray, keep_at: float, text_at: int):
    verdicts = _judge(weights, keep_at)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(text_at)], ["doc_id", "text"])
            kept = [part.column(7) for part in verdicts(iter([text]))]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return passing


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns; nothing is shuffled."""
    weights = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return arrow_map(docs, _passing(weights, keep_at, docs.columns.index(text_col)), docs.schema)
