"""Exact dedup by a cuckoo-filter index of live digests (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.hot import join_hot

from .common import arrow_map, cut_lineage

_MASK = (1 << 64) - 1
#: Slots in a bucket of the filter, and moves tried before it counts as full.
SLOTS, MOST_KICKS = 4, 200
#: Live digests that an index holds before it hands them on and begins anew (about 35 MB).
MOST_LIVE = 100_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over digests, with the full keys beside it.

    `filter[b]` holds up to SLOTS fingerprints of bucket b, and `content[b]` the keys and
    values in the same order. A look-up compares fingerprints first; only a hit looks at the
    content, which decides. Keys can be deleted, as the filter keeps one fingerprint for each.
    When an insertion finds no place after MOST_KICKS moves, the table doubles and is built
    anew from the stored keys, so that nothing is lost.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self._reset(1 << max(1, (buckets - 1).bit_length()))

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[list]] = [[] for _ in range(buckets)]
        self.size = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        print16 = (h >> 48) or 1
        first = h & self.mask
        return print16, first, self._other(first, print16)

    def _other(self, bucket: int, print16: int) -> int:
        return (bucket ^ ((print16 * 0x5BD1E9955BD1E995) & _MASK) >> 20) & self.mask

    def find(self, key: bytes) -> list | None:
        """The stored [key, value, ...] entry, or None."""
        print16, first, second = self._place(key)
        for bucket in (first, second):
            prints = self.filter[bucket]
            if print16 in prints:
                for entry in self.content[bucket]:
                    if entry[0] == key:
                        return entry
        return None

    def insert(self, entry: list) -> None:
        """Adds an entry whose key is not there yet."""
        print16, first, second = self._place(entry[0])
        bucket = first if len(self.filter[first]) <= len(self.filter[second]) else second
        for kick in range(MOST_KICKS):
            if len(self.filter[bucket]) < SLOTS:
                self.filter[bucket].append(print16)
                self.content[bucket].append(entry)
                self.size += 1
                return
            slot = kick % SLOTS
            self.filter[bucket][slot], print16 = print16, self.filter[bucket][slot]
            self.content[bucket][slot], entry = entry, self.content[bucket][slot]
            bucket = self._other(bucket, print16)
        self._grow(entry)

    def _grow(self, left_over: list) -> None:
        stored = [*self.entries(), left_over]
        self._reset(2 * (self.mask + 1))
        for entry in stored:
            self.insert(entry)

    def delete(self, key: bytes) -> bool:
        """Takes the key out; False if it was not there."""
        print16, first, second = self._place(key)
        for bucket in (first, second):
            for slot, entry in enumerate(self.content[bucket]):
                if entry[0] == key:
                    del self.filter[bucket][slot], self.content[bucket][slot]
                    self.size -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket


_PARTIAL = "digest binary, keep_id long, group_size long"


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["digest", "keep_id", "group_size"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows merged by digest; of a partition that is sorted by digest, one row for each.

    The index is handed on when it holds MOST_LIVE digests and a new one comes. In sorted rows
    all those of the earlier digests have then been seen; in others a digest may come again, and
    its rows meet by digest later. So memory is bounded whatever the partition holds.
    """
    index = CuckooIndex()
    for batch in batches:
        for digest, doc, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            live = index.find(digest)
            if live is None:
                if index.size >= MOST_LIVE:
                    yield _rows(index)
                    index = CuckooIndex()
                index.insert([digest, doc, size])
            elif doc is not None and (live[1] is None or doc > live[1]):
                # the later document takes over: the live entry goes, its successor comes
                index.delete(digest)
                index.insert([digest, doc, live[2] + size])
            else:
                live[2] += size
    yield _rows(index)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text's UTF-8 bytes, null text as the empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def live_groups(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): the largest id of each digest and its number of rows.

    Each partition first merges its own rows, so a digest that a third of all rows share sends
    one row for each partition; these then meet by digest.
    """
    rows = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    partial = arrow_map(rows, _merge, _PARTIAL)
    return arrow_map(partial.repartition("digest").sortWithinPartitions("digest"), _merge, _PARTIAL)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts form one
    group. The largest id of a group stays. A null id is the smallest. Rows that repeat both id
    and text are one document listed again: each of them is marked kept if its id is, and
    group_size counts them all. Other columns of docs, whatever their names, are not read.
    An empty table gives an empty result. Rows of a text that more than one row in 1000 has are
    told what stays where they are, and are not shuffled.
    """
    keyed = cut_lineage(digests(docs, id_col, text_col))
    live = cut_lineage(live_groups(keyed))
    total = live.agg(F.sum("group_size")).first()[0] or 0
    joined = join_hot(keyed, live.withColumn("rows", F.col("group_size")), "digest", "rows", total)
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def withdraw(index: CuckooIndex, gone: Iterator[bytes]) -> int:
    """Deletes the digests of documents that are no longer live; how many there were."""
    return sum(index.delete(digest) for digest in gone)


