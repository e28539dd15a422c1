"""Language identification: script ranges, word scores and a Viterbi path (operator 3)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flat, slices
from .quality_rules import HELD_OUT, fold

#: Documents of each language that the scores are learnt from, about, chosen by a hash of the id.
SAMPLE_ROWS = 1_000
#: Log2 of the number of hashed n-grams of each length.
TABLE_BITS = 15
#: What a change of language between two words costs, in nats of a word's score.
SWITCH = 6.0
#: A script belongs to a language if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
_LENGTHS = (2, 3, 4)
_STEP_BYTES = 4 << 20

# First code points of the blocks that part scripts; a letter's script is the
# last entry at or below it.
_SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31F0, "Kana"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in _SCRIPTS})
_FIRST = np.array([first for first, _ in _SCRIPTS])
_SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in _SCRIPTS], np.uint8)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


class Words:
    """The words of many texts: maximal runs of letters, with their n-grams."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)])
        letters = _letters()[points]
        inside = letters > 0
        self.starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        self.ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.at = np.flatnonzero(inside)
        self.heads = np.searchsorted(self.at, self.starts)
        self.size = self.ends - self.starts
        self.script = _SCRIPT_AT[np.searchsorted(_FIRST, points[self.starts], "right") - 1]
        padded = np.zeros(len(letters) + 4, np.uint64)
        padded[1 : 1 + len(letters)] = letters
        # each letter with the one before it and the ones after, up to the word's end
        before, here, after = padded[self.at], padded[self.at + 1], padded[self.at + 2]
        beyond = np.where(after > 0, padded[self.at + 3], 0)
        shift, odd = np.uint64(64 - TABLE_BITS), np.uint64(0x9E3779B97F4A7C15)
        pair = here << np.uint64(21) | after
        triple = before << np.uint64(42) | pair
        quad = (triple * np.uint64(0xD6E8FEB86659FD93)) ^ (beyond * np.uint64(0xA0761D6478BD642F))
        self.grams = [(g * odd >> shift).astype(np.int32) for g in (pair, triple, quad ^ (quad >> np.uint64(29)))]


class Model:
    """Log probabilities of hashed n-grams by language, and the scripts of each language."""

    def __init__(self, languages: list[str], tables: list[np.ndarray], scripts: np.ndarray) -> None:
        self.languages, self.tables, self.scripts = languages, tables, scripts

    def word_scores(self, words: Words) -> np.ndarray:
        """A score for each word and language; languages without the word's script fall far behind."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        by_letter = self.tables[0][words.grams[0]]
        for table, grams in zip(self.tables[1:], words.grams[1:], strict=True):
            by_letter += table[grams]
        scores = np.add.reduceat(by_letter, words.heads, axis=0) / len(_LENGTHS)
        candidates = self.scripts[words.script]
        candidates[~candidates.any(axis=1)] = True  # a script that nobody has narrows nothing
        return np.where(candidates, scores, scores.min(axis=1, keepdims=True) - 50).astype(np.float32)


def counted(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """How often each hashed n-gram stands in texts of one language, by length; its letters by script."""
    words = Words(texts)
    return [np.bincount(grams, minlength=1 << TABLE_BITS) for grams in words.grams], np.bincount(words.script, words.size, len(SCRIPTS))


def model_of(counts: dict[str, tuple[list[np.ndarray], np.ndarray]]) -> Model:
    """The model from each language's counts; rare n-grams are smoothed."""
    languages, size = sorted(counts), 1 << TABLE_BITS
    columns = [np.stack([counts[x][0][i] for x in languages], axis=1) if languages else np.zeros((size, 0)) for i in range(len(_LENGTHS))]
    scripts = np.stack([counts[x][1] for x in languages], axis=1) if languages else np.zeros((len(SCRIPTS), 0))
    tables = [np.log((c + 0.1) / (c.sum(axis=0) + 0.1 * size)).astype(np.float32) for c in columns]
    return Model(languages, tables, scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE)


def learn(pairs: Iterator[tuple[str, str]]) -> Model:
    """Learns from (text, language) pairs."""
    by_language: dict[str, list[str]] = {}
    for text, language in pairs:
        by_language.setdefault(language, []).append(text)
    return model_of({language: counted(texts) for language, texts in by_language.items()})


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, along each text; all texts step forward together."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    heads, counts = first[:-1][order], counts[order]
    n, languages = scores.shape
    stays = np.zeros((n, languages), bool)
    leader = np.zeros(n, np.int64)
    path = np.zeros(n, np.int64)
    value = np.zeros((len(counts), languages), np.float32)
    last = np.zeros(len(counts), np.int64)
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), "left")  # texts with more words than the step
    for step, many in enumerate(active.tolist()):
        at = heads[:many] + step
        v = value[:many]
        if step:
            best = v.argmax(axis=1)
            moved = v[np.arange(many), best] - switch
            stay = v >= moved[:, None]
            stays[at], leader[at] = stay, best
            v = np.where(stay, v, moved[:, None])
        value[:many] = v + scores[at]
    if steps:
        last = value.argmax(axis=1)
    for step in range(steps - 1, -1, -1):
        at = heads[: active[step]] + step
        now = last[: active[step]]
        path[at] = now
        if step:
            last[: active[step]] = np.where(stays[at, now], now, leader[at])
    return path


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def label(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of each text.

    Spans are maximal runs of words of one language, as code-point offsets. The language has the
    most letters in its spans, the first in order if two have as many; the score is its share.
    """
    words = Words(texts)
    if not model.languages or not len(words.starts):
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    path = viterbi(model.word_scores(words), words.first)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (owner, path), words.size)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    score = letters.max(axis=1) / np.maximum(total, 1)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(owner) != 0)]))
    tails = np.concatenate([heads[1:], [len(path)]]) - 1
    base = words.text_starts[owner[heads]]
    spans: list[list[dict]] = [[] for _ in texts]
    for i, start, end, language in zip(owner[heads].tolist(), (words.starts[heads] - base).tolist(), (words.ends[tails] - base).tolist(), path[heads].tolist(), strict=True):
        spans[i].append({"start": start, "end": end, "lang": model.languages[language]})
    names = [model.languages[b] if t else "und" for b, t in zip(best, total, strict=True)]
    return names, score.tolist(), spans


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, its counts) from rows (lang, text) that are sorted by language."""
    language, total, scripts = None, None, None

    def row() -> pa.RecordBatch:
        blob = np.concatenate([*total, scripts]).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([language]), pa.array([blob], pa.binary())], ["lang", "counts"])

    for batch in batches:
        for some in slices(batch, 1, _STEP_BYTES):
            names, texts = np.array(some.column(0).to_pylist(), object), some.column(1).to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                found, by_script = counted(texts[start:end])
                if names[start] != language:
                    if language is not None:
                        yield row()
                    language, total, scripts = names[start], [np.zeros(1 << TABLE_BITS) for _ in _LENGTHS], np.zeros(len(SCRIPTS))
                for t, f in zip(total, found, strict=True):
                    t += f
                scripts += by_script
    if language is not None:
        yield row()


def train(docs: DataFrame, per_language: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from about per_language documents of each language outside the held-out fold.

    A document is taken if a hash of its id falls under its language's share, so choosing needs
    one count for each language and no order over the table. Of an id's texts the one with the
    least hash counts. Each language is counted by one task, a few texts at a time; the driver
    gets a table of fixed size for each language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT))
    known = known.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    shares = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # a row for each language
    sample = drawn.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    dealt = sample.select("lang", "text").repartition("lang").sortWithinPartitions("lang")
    counts = {}
    for row in arrow_map(dealt, _count_rows, "lang string, counts binary").collect():
        *tables, scripts = np.split(np.frombuffer(row["counts"], "<i8"), [(i + 1) << TABLE_BITS for i in range(len(_LENGTHS))])
        counts[row["lang"]] = (tables, scripts)
    return model_of(counts)


def _identify(model: Model):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(flat(batch.column(2))[1])
            texts = [t or "" for t in batch.column(2).to_pylist()]
            row = 0
            while row < len(texts):
                end, room = row + 1, _STEP_BYTES - sizes[row]
                while end < len(texts) and room >= sizes[end]:
                    room -= sizes[end]
                    end += 1
                names, scores, spans = label(model, texts[row:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPAN)],
                    ["doc_id", "held_out", "lang_pred", "score", "spans"],
                )
                row = end

    return identify


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, spans.

    A text that is null or has no letters is `und` with score 0 and no spans, and so is every
    text if no language could be learnt. Null languages teach nothing. A null id is not held
    out, and isn't learnt from. Repeated rows repeat their result. Other columns are not read.
    An empty table gives an empty result.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    held = F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return arrow_map(rows, _identify(model), schema)
