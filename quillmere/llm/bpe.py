"""Byte-level BPE by a rank queue on a hierarchical bitmap (operator 2)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Pre-tokens that a worker remembers before it forgets them all; longer ones than LONGEST_KEPT
#: characters are merged every time. Texts are encoded together up to so many characters.
CACHE_PIECES, LONGEST_KEPT, GROUP_CHARS = 600_000, 64, 1 << 20
#: Bits in one word of the bitmap; a second level has one bit for each word.
_BITS = 8

#: White space as the rank files' library has it: the property of that name.
_WHITE_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_PLAIN = re.compile(r"[\n\x20-\x7E\xA1-\u024F]*")
# The byte-level pattern, and the same for texts of plain characters alone, where
# the standard library's classes agree with Unicode's but for the six numerals named.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_\xB2\xB3\xB9\xBC-\xBE]+| ?[\d\xB2\xB3\xB9\xBC-\xBE]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"


class RankQueue:
    """Buckets of linked-list positions by merge rank; the lowest rank comes first.

    The bitmap has a bit for each rank with a bucket, in words, and above them a bit for each
    word that isn't zero: two find-first-sets give the next rank. Entries are never removed
    when they go stale; whoever takes a bucket checks them.
    """

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks >> _BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Gives a rank without a bucket one."""
        self.buckets[rank] = positions
        word = rank >> _BITS
        self.words[word] |= 1 << (rank & ((1 << _BITS) - 1))
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, which is closed."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        rank = (word << _BITS) | ((bits & -bits).bit_length() - 1)
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class BytePairEncoder:
    """Encodes and decodes by a file of ranks: base64 of a token's bytes and its rank, by line."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        self.ints = list(range(self.size))  # one object for each id, which all results share
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(self.size)]
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)])
        # the rank of a pair is that of the joined bytes, however the token first came about
        self.pair_rank: list[dict[int, int]] = [{} for _ in range(self.size)]
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair_rank[left][right] = self.ints[rank]
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE_SPACE}").replace(r"\s", f"[{_WHITE_SPACE}]").replace(r"\S", f"[^{_WHITE_SPACE}]"))
        self.plain_pattern = re.compile(_PLAIN_PATTERN) if pattern == _PATTERN else self.pattern
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pre-tokens, merged side by side in one linked list and one queue.

        No pair reaches from one piece into the next, so ranks interleave freely between pieces
        while each piece sees its own lowest rank first, and in it the leftmost pair. n bytes
        take about n log n steps, so a very long piece is no harm.
        """
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        stops = np.cumsum([len(p) for p in pieces])
        first_ranks = np.full(n, -1)
        if n > 1:
            first_ranks[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
            first_ranks[stops - 1] = -1
        ints, pair_rank = self.ints, self.pair_rank
        tokens = [ints[t] for t in self.byte_rank[raw].tolist()]
        current = first_ranks.tolist()  # the rank of the pair that begins at a position
        following, before = list(range(1, n + 1)), list(range(-1, n))
        for stop in stops.tolist():  # the list ends with each piece
            following[stop - 1] = -1
            if stop < n:
                before[stop] = -1
        queue = RankQueue(self.size)
        buckets = queue.buckets
        order = np.argsort(first_ranks, kind="stable")
        order = order[np.searchsorted(first_ranks[order], 0) :]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(first_ranks[order]) > 0])) if len(order) else []
        for bucket in np.split(order, heads[1:]) if len(order) else []:
            queue.open(int(first_ranks[bucket[0]]), bucket.tolist())
        while queue.top:
            rank, bucket = queue.take()
            bucket.sort()
            merged = ints[rank]
            pairs_of_merged = pair_rank[rank]
            for nth, i in enumerate(bucket):
                if current[i] != rank:
                    continue  # stale: the pair has been merged or changed since
                j = following[i]
                k = following[j]
                tokens[i], tokens[j] = merged, None
                current[j] = -1
                following[i] = k
                lower = False
                if k >= 0:
                    before[k] = i
                    made = current[i] = pairs_of_merged.get(tokens[k], -1)
                    if made >= 0:
                        lower = made < rank
                        if made in buckets:
                            buckets[made].append(i)
                        else:
                            queue.open(made, [i])
                else:
                    current[i] = -1
                h = before[i]
                if h >= 0:
                    made = current[h] = pair_rank[tokens[h]].get(merged, -1)
                    if made >= 0:
                        lower = lower or made < rank
                        if made in buckets:
                            buckets[made].append(h)
                        else:
                            queue.open(made, [h])
                if lower:  # a pair that comes before the rest of this bucket
                    rest = bucket[nth + 1 :]
                    if rank in buckets:
                        buckets[rank] += rest
                    elif rest:
                        queue.open(rank, rest)
                    break
        out, start = [], 0
        for stop in stops.tolist():
            out.append(tuple([t for t in tokens[start:stop] if t is not None]))
            start = stop
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, each match of the pattern for itself.

        Pieces seen before are looked up; the others of all the texts are merged together.
        """
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known = self.pieces
        cut = [(self.plain_pattern if _PLAIN.fullmatch(t) else self.pattern).findall(t) for t in texts]
        found = [list(map(known.get, pieces)) for pieces in cut]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        new = list({p for i in lacking for p, ids in zip(cut[i], found[i], strict=True) if ids is None})
        if new:
            merged = dict(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
            known.update((p, ids) for p, ids in merged.items() if len(p) <= LONGEST_KEPT)
            for i in lacking:
                found[i] = [merged[p] if ids is None else ids for p, ids in zip(cut[i], found[i], strict=True)]
        return [list(chain.from_iterable(ids)) for ids in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(path, pattern)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_CHARS characters."""
    row = 0
    while row < len(texts):
        end, room = row + 1, GROUP_CHARS - len(texts[row])
        while end < len(texts) and room > 0:
            room -= len(texts[end])
            end += 1
        yield row, end
        row = end


def _digests(path: str, pattern: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            counts, digests, backs = [], [], []
            for row, end in _groups(texts):
                for ids in bpe.encode(texts[row:end]):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    backs.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digests


def _ids(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for row, end in _groups(texts):
                ids = pa.array(bpe.encode(texts[row:end]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), ids], ["doc_id", "ids"])

    return encode


def _texts(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return decode


def _rows(docs: DataFrame, id_col: str, other: str, name: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(other).alias(name))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's ids; null and empty texts have none."""
    return arrow_map(_rows(docs, id_col, text_col, "text"), _ids(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of the ids, joined; null ids have none."""
    return arrow_map(_rows(encoded, id_col, ids_col, "ids"), _texts(path, pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded, and its ids decoded. Null counts as empty: no ids, and the
    digests of nothing. Rows are independent, so repeated rows repeat their result. Other
    columns are not read. An empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(_rows(docs, id_col, text_col, "text"), _digests(path, pattern), schema)
