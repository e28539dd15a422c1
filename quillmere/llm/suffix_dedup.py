"""Removal of repeated byte strings by blockwise suffix sorting (operator 4).

Three passes, each over all texts. The first takes *anchors*: in each window of LENGTH bytes the
run of GRAM bytes with the least hash, so that equal windows have equal anchors at equal places.
Anchors that two different texts have are the only places where a string can repeat. The second
cuts the bytes around those out and deals them to suffix buckets by anchor. There the suffixes
are sorted, one block at a time, by difference-cover construction; runs of suffixes with LENGTH
bytes in common are the equal windows, and the least document of a run keeps its copy. The third
takes the others out of the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.hot import join_hot

from .common import arrow_map, chunks, cut_lineage, doc_key, slices, text_bytes
from .textscan import mix

#: The length of a repeated string, and of an anchor.
LENGTH, GRAM = 50, 20
#: A difference cover: any two residues modulo PERIOD meet the cover after the same number of steps.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Texts from which on an anchor's windows are dealt one by one, and log2 of the map of those.
HOT_FROM, HOT_BITS = 20_000, 22
#: Suffixes that are sorted at once, about.
BLOCK = 100_000
#: Bytes of text whose anchors make a bucket, and whose repeated parts make a suffix bucket.
ANCHOR_BYTES, SUFFIX_BYTES = 16 << 20, 1 << 20
#: Bytes of text whose anchors are sought at once, and whose rows go out together.
STEP_BYTES, SLICE_BYTES = 1 << 15, 16 << 20
_HEAD = 32  # bytes sorted before ties go to the cover's ranks; PERIOD at least


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, position, first window, last window) of each run of windows with one anchor."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    x = data.astype(np.uint64)
    two = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
    four = two[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]
    eight = four[:-4] * np.uint64(0x165667B19E3779F9) + four[4:]
    ids = mix((eight[:-12] * np.uint64(0xD6E8FEB86659FD93) + eight[8:-4]) * np.uint64(0xA0761D6478BD642F) + four[16:])
    least = (ids << np.uint64(32)) | np.arange(len(ids), dtype=np.uint64)
    span, wide = 1, LENGTH - GRAM + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    sizes = np.diff(bounds)
    inside = np.zeros(n + 1, np.int8)
    fits = sizes >= LENGTH
    inside[bounds[:-1][fits]] += 1
    inside[bounds[1:][fits] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(least)]))
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(at) != 1)]))
    tails = np.concatenate([heads[1:], [len(at)]]) - 1
    return mix(ids[place[heads]]), place[heads], at[heads], at[tails]


def _short(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor above 32 bits of its id; both together tell anchors apart."""
    return ((ids >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | (ids & np.uint64(0xFFFFFFFF))


_ANCHORS = "kind int, bucket int, keys binary, counts binary, ids binary"
_ANCHOR_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
# Kinds of rows: anchors that one text of a batch has, by bucket; anchors that several have, by
# bucket, with two of those texts and how many there are; and what is known to be shared already,
# as whole ids by texts, for any bucket to hand on.
_SINGLE, _SEVERAL, _KNOWN = 0, 1, 2


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, lengths) of the runs of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))[: len(values)]
    return heads, np.diff(np.concatenate([heads, [len(values)]]))


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist() if len(values) else []
    return list(zip(edges[:-1], edges[1:], strict=True))


def _anchor_rows(buckets: int, targets: int):
    """(text key, text) to rows of anchors, combined within a slice of the batch.

    However many texts of a slice have an anchor, its bucket hears of two.
    """

    def some_rows(batch: pa.RecordBatch) -> list[tuple]:
        text_keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        ids, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, _, data, bounds in chunks(batch.column(1), STEP_BYTES):
            found, place, _, _ = anchors(data, bounds)
            ids.append(_short(found, buckets))
            keys.append(text_keys[np.searchsorted(bounds, place, "right") - 1 + row])
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((keys, ids))
        ids, keys = ids[order], keys[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])[: len(ids)]
        ids, keys = ids[fresh], keys[fresh]
        heads, sizes = _runs(ids)
        several = np.repeat(sizes > 1, sizes)
        out = [(_KNOWN, (target * 7919 + len(ids)) % buckets, *blobs) for target, *blobs in _by_target(keys[several], ids[several], targets)]
        one_ids, one_keys = ids[~several], keys[~several]
        order = np.lexsort((one_keys, one_ids >> np.uint64(32)))
        one_ids, one_keys = one_ids[order], one_keys[order]
        for start, end in _cuts(one_ids >> np.uint64(32)):
            starts, counts = _runs(one_keys[start:end])
            out.append((_SINGLE, int(one_ids[start] >> np.uint64(32)), one_keys[start:end][starts].tobytes(), counts.astype("<u4").tobytes(), one_ids[start:end].astype("<u4").tobytes()))
        many, many_sizes = heads[sizes > 1], sizes[sizes > 1]
        for start, end in _cuts(ids[many] >> np.uint64(32)):
            some = many[start:end]
            two = np.stack([keys[some], keys[some + 1]], axis=1)
            out.append((_SEVERAL, int(ids[some[0]] >> np.uint64(32)), two.tobytes(), many_sizes[start:end].astype("<u4").tobytes(), ids[some].astype("<u4").tobytes()))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                columns = list(zip(*some_rows(some), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANCHOR_SCHEMA, strict=True)], schema=_ANCHOR_SCHEMA)

    return rows


def _by_target(keys: np.ndarray, ids: np.ndarray, targets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(target, keys, counts, whole ids) for the share of the texts that each target has."""
    order = np.lexsort((keys, keys % targets))
    keys, ids = keys[order], ids[order]
    target = keys % targets
    for start, end in _cuts(target):
        heads, counts = _runs(keys[start:end])
        yield int(target[start]), keys[start:end][heads].tobytes(), counts.astype("<u4").tobytes(), ids[start:end].astype("<u8").tobytes()


def by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """The rows of one bucket after another, from batches sorted by bucket; few rows are unpacked at once."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, len(batch), 256):
            for row in batch.slice(at, 256).to_pylist():
                if held and held[0][key] != row[key]:
                    yield held[0][key], held
                    held = []
                held.append(row)
    if held:
        yield held[0][key], held


_SHARED_SCHEMA = pa.schema([("target", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_HOT = -1


def _shared_rows(targets: int, hot_from: int):
    """The anchors that two texts have: a row for each target, and one of ids that very many have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            out = [(int(np.frombuffer(r["keys"], "<i8")[0] % targets), r["keys"], r["counts"], r["ids"]) for r in held if r["kind"] == _KNOWN]
            keys, ids, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for r in held:
                some, counts, low = np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["counts"], "<u4").astype(np.int64), np.frombuffer(r["ids"], "<u4")
                if r["kind"] == _SINGLE:
                    keys.append(np.repeat(some, counts))
                    ids.append(low.astype(np.uint64))
                    weights.append(np.ones(len(low), np.int64))
                elif r["kind"] == _SEVERAL:
                    keys.append(some)
                    ids.append(np.repeat(low, 2).astype(np.uint64))
                    weights.append(np.stack([counts - 1, np.ones_like(counts)], axis=1).reshape(-1))
            keys, ids, weights = np.concatenate(keys), np.concatenate(ids) | np.uint64(bucket) << np.uint64(32), np.concatenate(weights)
            order = np.lexsort((keys, ids))
            keys, ids, weights = keys[order], ids[order], weights[order]
            heads, sizes = _runs(ids)
            shared = np.zeros(len(ids), bool)
            if len(ids):
                # equal ids are shared if their least and greatest text differ
                shared = np.repeat(keys[heads] != keys[heads + sizes - 1], sizes)
                hot = ids[heads][np.add.reduceat(weights, heads) >= hot_from]
                if len(hot):
                    out.append((_HOT, b"", b"", hot.astype("<u8").tobytes()))
            out += _by_target(keys[shared], ids[shared], targets)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARED_SCHEMA, strict=True)], schema=_SHARED_SCHEMA)

    return rows


def _hot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap of all hot ids, hashed."""
    bits = np.zeros(1 << HOT_BITS, bool)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            bits[_hot_place(np.frombuffer(blob, "<u8"))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _hot_place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids) >> np.uint64(64 - HOT_BITS)).astype(np.int64)


def _gathered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text key, all its shared anchors) from the rows of each target's texts, one target after another."""
    for _, rows in by_bucket(batches, "target"):
        keys = np.concatenate([np.repeat(np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["counts"], "<u4")) for r in rows])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u8") for r in rows])
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        cuts = _cuts(keys)
        for at in range(0, len(cuts), 1_000):
            some = cuts[at : at + 1_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[[i for i, _ in some]], pa.int64()), pa.array([ids[i:j].astype("<u8").tobytes() for i, j in some], pa.binary())], ["key", "shared"])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text) with the text's bytes compressed, as they are to be shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for some in slices(batch, 2, SLICE_BYTES):
            packed = [press.compress((t or "").encode()) for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(packed, pa.binary())], ["doc", "key", "packed"])


def _unpacked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in runs of rows whose unpacked texts have about SLICE_BYTES, with those texts."""
    held, start, size = [], 0, 0
    for row, packed in enumerate(batch.column(column)):
        raw = zstandard.decompress(packed.as_py())
        if held and size + len(raw) > SLICE_BYTES:
            yield batch.slice(start, row - start), held
            held, start, size = [], row, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield batch.slice(start), held


def _segment_rows(buckets: int, suffix_buckets: int, hot_bits: bytes | None):
    """(doc, key, text, shared anchors) to a row for each bucket: the bytes around those anchors.

    Of equal segments in a batch only that of the least document goes on. The others repeat it
    whole, which is said at once by rows of bucket -1. Around an anchor that very many texts have
    each window is a segment of its own, dealt by its content: equal ones still meet, and no
    bucket gets all of the anchor's surroundings.
    """
    hot = None if hot_bits is None else np.unpackbits(np.frombuffer(hot_bits, np.uint8)).astype(bool)

    def some_rows(batch: pa.RecordBatch, raws: list[bytes]) -> list[tuple]:
        docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        shared = batch.column(3)
        groups: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for row, end, data, bounds in chunks(pa.array(raws, pa.large_binary()), STEP_BYTES):
            ids, place, first, last = anchors(data, bounds)
            if not len(ids):
                continue
            short = _short(ids, buckets)
            deal = (mix(ids) % np.uint64(suffix_buckets)).astype(np.int64).tolist()
            parted = np.zeros(len(ids), bool) if hot is None else hot[_hot_place(short)]
            owner = np.searchsorted(bounds, place, "right") - 1
            edges = np.searchsorted(owner, np.arange(end - row + 1))
            raw = data.tobytes()
            for i in range(end - row):
                part = slice(edges[i], edges[i + 1])
                wanted = np.frombuffer(shared[row + i].as_buffer(), "<u8")
                hit = np.flatnonzero(np.isin(short[part], wanted)) + edges[i]
                base = int(bounds[i])
                for j, lo, hi in zip(hit.tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                    if parted[j]:
                        for at in range(lo, hi + 1):
                            window = raw[at : at + LENGTH]
                            groups.setdefault(zlib.crc32(window) % suffix_buckets, {}).setdefault(window, []).append((row + i, at - base))
                    else:
                        groups.setdefault(deal[j], {}).setdefault(raw[lo : hi + LENGTH], []).append((row + i, lo - base))
        out = []
        whole: dict[int, list[int]] = {}
        for b, contents in groups.items():
            owners_, places, sent = [], [], []
            for content, held in contents.items():
                least = min(docs[i] for i, _ in held)
                for i, lo in held:
                    if docs[i] > least:
                        whole.setdefault(i, []).extend((lo, lo + len(content)))
                    else:
                        owners_.append(i)
                        places.append(lo)
                        sent.append(content)
            ids_of = [np.array([column[i] for i in owners_], "<i8").tobytes() for column in (docs, keys)]
            out.append((b, *ids_of, np.array(places, "<i8").tobytes(), np.array([len(c) for c in sent], "<i8").tobytes(), zstandard.compress(b"".join(sent))))
        for i, spans in whole.items():
            out.append((-1, *(np.array([c[i]], "<i8").tobytes() for c in (docs, keys)), np.array(spans, "<i8").tobytes(), b"", b""))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, raws in _unpacked(batch, 2):
                columns = list(zip(*some_rows(some, raws), strict=True)) or [()] * 6
                types = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "docs", "keys", "places", "sizes", "bytes"])

    return rows


def _meeting() -> np.ndarray:
    """For two residues, the least number of steps that takes both into the cover."""
    inside = np.zeros(2 * PERIOD, bool)
    inside[list(COVER)] = inside[[c + PERIOD for c in COVER]] = True
    table = np.full((PERIOD, PERIOD), -1, np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if inside[a + d] and inside[b + d])
    return table


_MEETING = _meeting()
#: Which of the cover's residues a position's is.
_COVER_NTH = np.array([sum(c < r for c in COVER) for r in range(PERIOD)])


class SuffixSorter:
    """Sorts suffixes of joined segments; a suffix ends with its segment.

    Each segment's end counts as a letter below all bytes, lower in earlier segments, so no two
    suffixes are equal. The cover's positions are ranked beforehand. A block of suffixes is then
    sorted by its first bytes, and ties, however long, by the ranks of the cover's positions at
    the first step where both suffixes stand on the cover. What is held for each byte is the
    byte, its segment's number, and a rank for the share of the cover (under 7 bytes in all); sort
    keys are taken from the bytes for a block at a time.
    """

    def __init__(self, data: np.ndarray, stops: np.ndarray) -> None:
        """data: the segments, each followed by a zero byte; stops: the places of those."""
        self.size = len(data)
        self.padded = np.zeros(self.size + 2 * _HEAD, np.uint8)
        self.padded[: self.size] = data
        # the eight bytes from any place on, as a number; a view of the bytes, not a copy
        self.words = np.ndarray(self.size + _HEAD, ">u8", self.padded.data, strides=(1,))
        self.stops = stops
        self.segment = np.repeat(np.arange(len(stops), dtype=np.int32), np.diff(np.concatenate([[-1], stops])))
        self.rank = np.zeros(0, np.int32)
        self._rank_cover()

    def word(self, at: np.ndarray, nth: int) -> np.ndarray:
        """The nth eight bytes of suffixes, zeros after the segment's end."""
        start = at + 8 * nth
        left = self.stops[self.segment[at]] - start
        value = self.words[np.minimum(start, self.size + _HEAD - 1)].astype(np.uint64)
        drop = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left <= 0, np.uint64(0), value >> np.minimum(drop, np.uint64(63)) << np.minimum(drop, np.uint64(63)))

    def cover_rank(self, at: np.ndarray) -> np.ndarray:
        """The ranks of positions on the cover; -1 from the end on."""
        return self.rank[at // PERIOD * len(COVER) + _COVER_NTH[at % PERIOD]]

    def _rank_cover(self) -> None:
        """Ranks of the cover's positions, comparing eight bytes more of those still tied."""
        at = (np.arange(-(-self.size // PERIOD), dtype=np.int64)[:, None] * PERIOD + np.array(COVER)).reshape(-1)
        at = at[at < self.size]
        longest = int((self.stops[self.segment[at]] - at).max(initial=0))
        opens = np.zeros(len(at) + 1, bool)  # where a group of equal beginnings begins
        opens[[0, -1]] = True
        for nth in range(-(-longest // 8)):
            tied = np.flatnonzero(~(opens[:-1] & opens[1:]))
            if not len(tied):
                break
            group, value = np.cumsum(opens[:-1])[tied], self.word(at[tied], nth)
            order = np.lexsort((value, group))
            at[tied] = at[tied][order]
            group, value = group[order], value[order]
            opens[tied[1:]] |= (np.diff(group) == 0) & (value[1:] != value[:-1])
        tied = np.flatnonzero(~(opens[:-1] & opens[1:]))
        # the shorter of two with the same bytes comes first, then the earlier
        left = self.stops[self.segment[at[tied]]] - at[tied]
        at[tied] = at[tied][np.lexsort((at[tied], left, np.cumsum(opens[:-1])[tied]))]
        self.rank = np.full((self.size // PERIOD + 2) * len(COVER), -1, np.int32)
        self.rank[at // PERIOD * len(COVER) + _COVER_NTH[at % PERIOD]] = np.arange(len(at), dtype=np.int32)

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes in order."""
        heads = [self.word(at, nth) for nth in range(_HEAD // 8)]
        order = np.lexsort(heads[::-1])
        at = at[order]
        differs = np.zeros(max(0, len(at) - 1), bool)
        for head in heads:
            differs |= head[order][1:] != head[order][:-1]
        group = np.cumsum(np.concatenate([[False], differs])) if len(at) else np.zeros(0, np.int64)
        return self._break_ties(at, group)

    def _break_ties(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Quicksort of all tied groups at once: each splits around a suffix of its middle."""
        while True:
            heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))[: len(group)]
            sizes = np.diff(np.concatenate([heads, [len(group)]]))
            tied = np.repeat(sizes > 1, sizes)
            if not tied.any():
                return at
            where = np.flatnonzero(tied)
            pivot = at[np.repeat(heads + sizes // 2, sizes)[where]]
            mine = at[where]
            step = _MEETING[mine % PERIOD, pivot % PERIOD]
            part = np.zeros(len(at), np.int64)
            part[where] = np.sign(self.cover_rank(mine + step) - self.cover_rank(pivot + step))
            order = np.lexsort((part, group))
            at, group, part = at[order], group[order], part[order]
            group = np.cumsum(np.concatenate([[False], (np.diff(group) != 0) | (np.diff(part) != 0)]))

    def same(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether each suffix has its first bytes in common with the one before it."""
        out = np.ones(len(at), bool)
        out[:1] = False
        for start in range(0, length, 8):
            keep = np.uint64(8 * max(0, start + 8 - length))
            value = self.words[at + start].astype(np.uint64) >> keep
            out[1:] &= value[1:] == value[:-1]
        return out


def repeated_windows(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each byte of joined segments, whether the window there starts in a lesser document too."""
    stops = np.cumsum(sizes + 1) - 1
    joined = np.zeros(int((sizes + 1).sum()), np.uint8)
    inside = np.ones(len(joined), bool)
    inside[stops] = False
    joined[inside] = data
    sorter = SuffixSorter(joined, stops)
    repeated = np.zeros(len(joined), bool)
    # the suffixes that hold a window, as runs of each segment
    full = np.flatnonzero(sizes >= LENGTH)
    first, count = (stops - sizes)[full], (sizes - LENGTH + 1)[full]
    total = int(count.sum())
    if not total:
        return repeated[inside]
    all_at = (np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)).astype(np.int32)
    blocks = -(-total // BLOCK)
    lead = lambda at: sorter.words[at].astype(np.uint64)
    cuts = np.unique(np.quantile(lead(all_at[:: max(1, total // (1_000 * blocks))]), np.linspace(0, 1, blocks + 1)[1:-1], method="nearest")) if blocks > 1 else np.zeros(0, np.uint64)
    bucket = np.empty(total, np.uint16)
    for at in range(0, total, BLOCK):
        bucket[at : at + BLOCK] = np.searchsorted(cuts, lead(all_at[at : at + BLOCK]), "right")
    for b in range(len(cuts) + 1):
        at = sorter.sort(all_at[bucket == b].astype(np.int64))
        if not len(at):
            continue
        heads = np.flatnonzero(~sorter.same(at, LENGTH))
        doc = docs[sorter.segment[at]]
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.concatenate([heads, [len(at)]])))
        repeated[at[least < doc]] = True
    return repeated[inside]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, spans of the text that are to go), for each suffix bucket."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])
    for bucket, rows in by_bucket(batches):
        docs, keys, places, sizes = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("docs", "keys", "places", "sizes"))
        if bucket < 0:
            spans = [r["places"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys), pa.array(spans, pa.binary())], schema=schema)
            continue
        raw = b"".join(zstandard.decompress(r["bytes"]) for r in rows)
        stops = np.cumsum(sizes)
        docs_, places_ = docs.tolist(), places.tolist()
        contents: dict[bytes, list[int]] = {}
        for i, (start, stop) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), strict=True)):
            contents.setdefault(raw[start:stop], []).append(i)
        least = [min([docs_[i] for i in held]) for held in contents.values()]
        once = np.array([len(c) for c in contents])
        hit = np.flatnonzero(repeated_windows(np.array(least), once, np.frombuffer(b"".join(contents), np.uint8)))
        of = np.searchsorted(np.cumsum(once), hit, "right")
        hit = hit - (np.cumsum(once) - once)[of]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of) != 0)]))[: len(hit)]
        tails = np.concatenate([heads[1:], [len(hit)]])[: len(heads)] - 1
        runs: dict[int, list[tuple[int, int]]] = {}
        for nth, start, end in zip(of[heads].tolist(), hit[heads].tolist(), (hit[tails] + LENGTH).tolist(), strict=True):
            runs.setdefault(nth, []).append((start, end))
        spans_of: dict[int, list[int]] = {}
        for nth, ((content, held), low) in enumerate(zip(contents.items(), least, strict=True)):
            for i in held:
                for start, end in [(0, len(content))] if docs_[i] > low else runs.get(nth, ()):
                    spans_of.setdefault(i, []).extend((places_[i] + start, places_[i] + end))
        by_text: dict[tuple[int, int], list[int]] = {}
        for i, spans in spans_of.items():
            by_text.setdefault((int(docs[i]), int(keys[i])), []).extend(spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in by_text], pa.int64()), pa.array([k for _, k in by_text], pa.int64()), pa.array([np.array(s, "<i8").tobytes() for s in by_text.values()], pa.binary())],
            schema=schema,
        )


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching (start, end) pairs, merged."""
    out: list[tuple[int, int]] = []
    for start, end in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _removal(as_text: bool):
    """as_text: what is left comes as text, without the parts of characters that a cut has left."""

    def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in ((some, raws) for batch in batches for some, raws in _unpacked(batch, 2)):
            out = []
            for doc, key, raw, copy, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if copy and len(raw) >= LENGTH:
                    gone = [(0, len(raw))]
                elif copy or not spans:
                    gone = []
                else:
                    gone = merged(np.concatenate([np.frombuffer(s, "<i8") for s in spans]).reshape(-1, 2))
                kept, at = [], 0
                for start, end in gone:
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, key, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if as_text else left, [{"start": a, "end": b} for a, b in gone]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = [*[pa.int64()] * 5, pa.string(), pa.string() if as_text else pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return removal


_RESULT = "doc long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {}, spans array<struct<start:long,end:long>>"


def text_key(text_col: str = "text"):
    """What tells the texts of one document id apart in the result, should there be several."""
    return F.xxhash64(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, hot_from: int = HOT_FROM) -> DataFrame:
    """One row for each document: doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256,
    kept, spans.

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id.
    Strings are judged on the input, and never reach over a text's end. `kept` is what is left,
    as bytes, since a cut may part a character; as_text gives a text without such parts. Null counts as empty; shorter texts than LENGTH lose
    nothing. A null id counts as larger than all others. Rows with the same id never take
    anything from each other, so of repeated rows all or none lose a byte. Other columns are not
    read. An empty table gives an empty result.

    Texts are dealt once, by id and digest; both later passes read that exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(doc_key(id_col).alias("doc"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("sha"))
    size = text_bytes(rows)
    buckets, suffix_buckets = -(-size // ANCHOR_BYTES) or 1, -(-size // SUFFIX_BYTES) or 1
    narrow = rows.select("doc", "key", "sha")
    least = narrow.groupBy("sha").agg(F.min("doc").alias("least"), F.first("key").alias("key"), F.count(F.lit(1)).alias("n"))
    info = join_hot(narrow.distinct(), least.select("sha", "least", "n"), "sha", "n", rows.count()).select("doc", "key", (F.col("least") < F.col("doc")).alias("copy"))

    dealt = arrow_map(rows.select("key", "text"), _anchor_rows(buckets, buckets), _ANCHORS)
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = cut_lineage(arrow_map(dealt, _shared_rows(buckets, hot_from), "target int, keys binary, counts binary, ids binary"))
    # a bitmap of fixed size, whatever the number of hot anchors
    bits = arrow_map(found.where(F.col("target") == _HOT).select("ids").repartition(1), _hot_bits, "bits binary").collect()
    hot = bytes(bits[0]["bits"]) if bits and any(bits[0]["bits"]) else None
    shared = found.where("target >= 0").repartition(buckets, "target").sortWithinPartitions("target")
    shared = arrow_map(shared, _gathered_rows, "key long, shared binary")
    places = shared.join(least.select("key", F.col("least").alias("doc")), "key")

    texts = arrow_map(rows.select("doc", "key", "text"), _packed_rows, "doc long, key long, packed binary").repartition(buckets, "doc", "key")
    around = texts.join(places, ["doc", "key"]).select("doc", "key", "packed", "shared")
    segments = arrow_map(around, _segment_rows(buckets, suffix_buckets, hot), "bucket int, docs binary, keys binary, places binary, sizes binary, bytes binary")
    salt = F.when(F.col("bucket") < 0, F.xxhash64("docs", "keys")).otherwise(F.lit(0))
    segments = segments.withColumn("salt", salt).repartition(buckets, "bucket", "salt").drop("salt").sortWithinPartitions("bucket")
    spans = arrow_map(segments, _span_rows, "doc long, key long, spans binary").groupBy("doc", "key").agg(F.collect_list("spans").alias("spans"))

    judged = texts.join(info, ["doc", "key"]).join(spans, ["doc", "key"], "left").select("doc", "key", "packed", "copy", "spans")
    result = arrow_map(judged, _removal(as_text), _RESULT.format("string" if as_text else "binary"))
    doc_id = F.when(F.col("doc") != F.lit((1 << 63) - 1), F.col("doc")).alias("doc_id")
    return result.select(doc_id, F.col("key").alias("text_key"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
