"""Best-fit packing planned on a histogram of lengths (operator 1)."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage, global_rank

MAX_TOKENS = 2048
# For texts of these characters alone, both tokenizer libraries cut alike whatever their version
# of Unicode; texts with others go to `tokenizers`.
_PLAIN = re.compile(r"[\n\x20-\x7E\xA1-\u024F]*")
#: What a tokenizers file must cut as PATTERN does to take the fast way.
_SAMPLE = "It's  a test, isn't it?\n\n  We'll see 12345 caf\u00e9s -- don't \u00bd!!x_y\n z" + "".join(f"a{chr(c)} {chr(c)}1" for c in (*range(32, 127), *range(0xA1, 0x250)))


class Ids:
    """The ids of texts by a byte-level tokenizers file, as little-endian unsigned 32-bit numbers.

    Plain texts take the fast way: the file's own vocabulary as ranks in `tiktoken`. That gives
    the same ids. Two neighbours that join to a token T cover T's bytes with no merge over their
    edges, so they came about as they would in T alone; if T alone becomes T, its last merge is
    theirs. The driver checks once that each token of the vocabulary does, and that the file cuts
    texts by the same pattern (`agrees`); a file that doesn't pass, and texts that hold one of its
    added tokens, are left to `tokenizers`.
    """

    def __init__(self, path: str, fast_agrees: bool = True) -> None:
        self.fast_agrees = fast_agrees
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.shown)}
        self.ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast_agrees and _PLAIN.fullmatch(text) and not self.added.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def agrees(self) -> bool:
        """Whether the file cuts a sample as PATTERN does, and its merges turn the bytes of each token into that token."""
        cut = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(_SAMPLE)] if self.tokenizer.pre_tokenizer else []
        if self.tokenizer.normalizer or cut != ["".join(self.shown[b] for b in piece.encode()) for piece in regex.findall(PATTERN, _SAMPLE)]:
            return False
        tokenize = self.tokenizer.model.tokenize
        return all([x.id for x in tokenize("".join(self.shown[b] for b in token))] == [rank] for token, rank in self.ranks.items())


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level file.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for U+0100 and on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


@lru_cache(maxsize=2)
def _tokenizer(path: str, fast_agrees: bool) -> Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Ids(path, fast_agrees)


@lru_cache(maxsize=4)
def _agrees(path: str) -> bool:
    return Ids(path).agrees()


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, most: int, fast_agrees: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, fast_agrees)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for doc, text in zip(docs, batch.column(1), strict=True):
                ids = np.append(tokenizer(text.as_py() or ""), end)
                start, piece = 0, 0
                stop = len(ids) % most or most  # the first piece takes what is over
                while start < len(ids):
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop])))
                    start, stop, piece = stop, stop + most, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, most: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `most`; the first may be shorter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, _cut(tokenizer_path, end_id, most, _agrees(tokenizer_path)), _PIECES)


def plan(histogram: dict[int, int], most: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank from, rank to, first sequence, per sequence, offset).

    The pieces of one length with ranks in [from, to) fill sequences in order from the first,
    `per sequence` to each, beginning at the offset. Sequences with equal residuals are held as
    ranges, so the work and the plan depend on the number of lengths, not of pieces. As best fit
    goes on with the sequence that it has just used (no residual is smaller and still large
    enough), a whole range is filled in one step.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    residuals: list[int] = []  # a heap can't search; lengths fall, so a sorted list does

    def put(residual: int, first: int, count: int) -> None:
        if residual and count:
            if residual not in open_:
                open_[residual] = []
                bisect.insort(residuals, residual)
            open_[residual].append((first, count))

    out = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, count = open_[residual].pop()
                if not open_[residual]:
                    del open_[residual], residuals[at]
            else:
                residual, first = most, sequences
                count = -(-left // (most // length))
                sequences += count
            each = residual // length
            used = min(count, -(-left // each))
            taken = min(left, used * each)
            out.append((length, rank, rank + taken, first, each, most - residual))
            put(residual, first + used, count - used)
            whole, part = divmod(taken, each)
            put(residual - each * length, first, whole)
            if part:
                put(residual - part * length, first + whole, 1)
            rank, left = rank + taken, left - taken
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, most: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: none) and the end id, so an empty one is a piece of one
    token. Longer ones than `most` are cut; their first piece takes what is over. Pieces are
    packed best-fit decreasing by length; a sequence holds at most `most` tokens without gaps.
    Repeated rows are packed each for itself, and so are null ids. Other columns are not read.
    An empty table gives an empty result.
    """
    cut = cut_lineage(pieces(docs, tokenizer_path, end_id, most, id_col, text_col))
    # one row for each length, so `most` at the most
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    slots = spark.createDataFrame(
        plan(histogram, most), "length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long"
    )
    ranked = global_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    # the plan depends on `most` alone, not on the number of documents
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= rank_from AND rank < rank_to")
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
