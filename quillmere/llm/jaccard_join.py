"""N-gram Jaccard join with a count-vector R-tree (operator 6).

Equal shingle sets are one node. Sets that are similar enough share one of the few marks that
each has, see `prefix`: a small set's are pairs of shingles, a larger one's are small hashed
groups of them. Sets that share a mark, directly or through others, form a block: no link leaves
it. Single shingles would not do, since among enough texts most share one with some other: a
growing part of them would be one block. Sets meet in tasks of a bounded number of shingles, where an R-tree over
their count vectors finds the pairs worth an exact comparison.

A block of up to UNIT shingles meets in one task. Of a larger one only the count vectors meet, in
tiles by size class; sets whose bound allows a link, directly or through others, form the smaller
blocks whose texts meet. If such a block is still large, each tile of it first meets some leaders
of its class, which links most of a large group of copies by shuffling each set about once. Only
sets that are still outside their block's largest group then meet the tiles of sizes that could
link with them; pairs of that group's own sets need no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, cut_lineage, doc_key, slices
from .components import components
from .suffix_dedup import by_bucket
from .textscan import LOWER, mix, shingle_sets, span_hashes, windows, word_spans

#: Words in a shingle; two sets link from OVER / UNDER of their union on.
WORDS, OVER, UNDER = 5, 4, 5
#: Log2 of the least and the most bits of a bitmap, and of its parts. It has BITS_PER_ROW for
#: each row in between.
LEAST_BITS, MOST_BITS, PART_BITS, BITS_PER_ROW = 20, 27, 6, 64
#: Log2 of the shingles that a task remembers to see which ones come again.
SEEN_BITS = 20
#: Bytes of text that are worked on, and whose rows go out, at once; and those whose marks make
#: a bucket.
SLICE_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Log2 of the least number of shingles of a set whose marks are groups, and of its groups.
GROUPED_BITS = 6
#: Shingles of the sets of a tile, and of a class's leaders, about.
UNIT, LEADERS = 1 << 18, 1 << 15
#: Shingles of the sets of a tile of count vectors, about.
VECTOR_UNIT = 1 << 22
#: More than the tiles of any size class.
TILES = 1 << 32
#: Rows of a plan by block or size class that are broadcast, at most; larger plans are shuffled.
FEW = 100_000
#: Points in a leaf of the tree, and children of a node.
FAN = 32
#: Sets that a set is compared with at first; each time none of them joins it, twice as many are next.
AT_FIRST = 64


def _parts(places: np.ndarray, bits: int) -> pa.RecordBatch:
    """Places of a bitmap, by the part of it that they belong to."""
    found = np.unique(places).astype("<u4")
    part = found >> np.uint32(bits - PART_BITS)
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))[: len(part)]
    blobs = [x.tobytes() for x in np.split(found, edges[1:])] if len(found) else []
    return pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "places"])


def _repeated(bits: int):
    """Places of shingles that a task meets in two of its texts.

    Those of one chunk are compared with each other, and with what the task remembers of the
    chunks before: a table of fixed size, in which a new shingle takes the place of an old one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEEN_BITS, np.uint64)
        for batch in batches:
            for some in slices(batch, 0, SLICE_BYTES):
                found = [np.zeros(0, np.uint64)]
                for _, _, data, bounds in chunks(some.column(0)):
                    lower = LOWER[data]
                    starts, ends, first = word_spans(lower, bounds)
                    joined, at = windows(span_hashes(lower, starts, ends), first, WORDS)
                    order = np.argsort(joined, kind="stable")
                    owner, ordered = np.searchsorted(first, at, "right")[order], joined[order]
                    found.append(ordered[1:][(ordered[1:] == ordered[:-1]) & (owner[1:] != owner[:-1])])
                    slot = (joined & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)
                    found.append(joined[seen[slot] == joined])
                    seen[slot] = joined
                yield _parts(np.concatenate(found) >> np.uint64(64 - bits), bits)

    return rows


def _wanted(bits: int):
    """Places of the texts (doc, text key)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parts(_place(batch) >> np.uint64(64 - bits), bits)

    return rows


def _place(batch: pa.RecordBatch) -> np.ndarray:
    doc, text_key = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for i in (0, 1))
    return mix(mix(doc) + text_key)


def _marks(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash the bit at its place, as 0 or 1."""
    place = hashes >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)


def _bitmaps(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << (bits - PART_BITS)
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                maps.setdefault(part, np.zeros(width, bool))[np.frombuffer(blob.as_buffer(), "<u4") % width] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["part", "bits"])

    return rows


def bitmap(df: DataFrame, places, rows: int) -> np.ndarray:
    """A bitmap of what `places` finds in df. Its size follows from `rows` and is bounded, so it
    may fill up: that changes what the join costs, never what it finds."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ROW * rows).bit_length()))
    found = arrow_map(df, places(bits), "part int, places binary").repartition("part")
    out = np.zeros((1 << PART_BITS, (1 << (bits - PART_BITS)) // 8), np.uint8)
    for row in arrow_map(found, _bitmaps(bits), "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def level(n: int) -> int:
    """Which groups tell sets of n shingles: 2 ** (GROUPED_BITS + level), one for 1 to 2 of them; -1: pairs do."""
    return max(-1, n.bit_length() - 1 - GROUPED_BITS)


def prefix(shingles: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """The set's marks, of which any similar set that isn't equal has one among its own.

    Of two similar sets the level of the larger one counts, so a set has marks of its own level
    and of that of its largest partner, if they differ. With pairs: a partner shares OVER / UNDER
    of this set at least, so two of the first shingles, in an order that all agree on, are shared
    if there are two more than a partner may miss. With groups: a set differs from a partner by
    at most a quarter of its shingles, each of which changes one group; so the first groups will
    do, one more than that. Groups without shingles don't count: a set has more others than it
    needs but for a chance below 10 ** -20. Repeated shingles come last, as do groups of few others.
    """
    n = len(shingles)
    own, up = level(n), level(n * UNDER // OVER)
    if n * UNDER // OVER == n:
        return np.zeros(0, np.uint64)  # similar to equal sets alone
    mark = _marks(repeated, shingles).astype(np.uint64)
    found = []
    if own < 0:
        size = n - -(-n * OVER // UNDER) + 2
        key = mark << np.uint64(63) | mix(shingles) >> np.uint64(1)
        first = np.sort(shingles[np.argpartition(key, size - 1)[:size]])
        i, j = np.triu_indices(size, 1)
        found.append(mix(first[i] * np.uint64(0xD6E8FEB86659FD93) + first[j]))
    if up < 0:
        return found[0]
    # in order, so that groups of 2 ** bits are runs of equal first bits
    order = np.sort(mix(shingles) & ~np.uint64(1) | mark)
    weight = 4 - 3 * (order & np.uint64(1)).astype(np.int64)
    size = (n * UNDER // OVER - n) + 1
    for at in sorted({own, up} - {-1}):
        group = order >> np.uint64(64 - GROUPED_BITS - at)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        marks = mix(np.add.reduceat(order, heads) + np.uint64(at))
        if size < len(heads):
            heavy = np.minimum(np.add.reduceat(weight, heads), 8).astype(np.uint64)
            marks = marks[np.argpartition((np.uint64(8) - heavy) << np.uint64(61) | marks >> np.uint64(3), size - 1)[:size]]
        found.append(marks)
    return np.concatenate(found)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that equal sets alone share."""
    n = np.uint64(len(shingles))
    first = np.bitwise_xor.reduce(mix(shingles + np.uint64(1)))
    second = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)).sum()
    both = np.array([first, second], np.uint64) ^ mix(np.full(2, len(shingles), np.uint64))
    return tuple(both.view(np.int64).tolist())


_DEALT = "bucket int, keys binary, classes binary, ids binary"


def _class_of(n: int) -> int:
    """The size class: sets that link are of one or of neighbouring ones."""
    return math.floor(math.log(n) / math.log(UNDER / OVER))


def _prefix_rows(repeated: np.ndarray, buckets: int):
    """(doc, text key, text) to rows for buckets of marks; those of negative buckets have the sets' digests as ids."""

    def some_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        narrow: list[tuple] = []
        ids, sizes, keys, classes = [], [], [], []
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seen: set[int] = set()
        for row, _, data, bounds in chunks(batch.column(2)):
            for i, shingles in enumerate(shingle_sets(data, bounds, WORDS), row):
                first, second = _digest(shingles)
                narrow.append((docs[i], texts[i], first, second, len(shingles)))
                if len(shingles) and first not in seen:
                    seen.add(first)
                    some = prefix(shingles, repeated)
                    ids.append(some)
                    sizes.append(len(some))
                    keys.append(first)
                    classes.append(_class_of(len(shingles)))
        if narrow:
            yield -1 - (narrow[0][1] & 0x7FFFFFFF) % buckets, b"", b"", np.array(narrow, "<i8").tobytes()
        if not sum(sizes):
            return
        ids, owner = mix(np.concatenate(ids) + np.uint64(7)), np.repeat(np.arange(len(keys)), sizes)
        bucket = ((ids >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        owner, bucket, low = owner[order], bucket[order], (ids[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
        key, kind = np.array(keys, "<i8")[owner], np.array(classes, np.uint8)[owner]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(bucket[start]), key[start:end].tobytes(), kind[start:end].tobytes(), low[start:end].tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, SLICE_BYTES):
                columns = list(zip(*some_rows(some), strict=True)) or [()] * 4
                types = [pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "keys", "classes", "ids"])

    return rows


def _narrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            table = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(5)], ["doc", "text_key", "node", "check", "n"])


class Forest:
    """Union-find over numbered items; a root is its tree's least."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that tie together the sets of a bucket that share a mark and could link; digests go on as they are.

    Of the sets with one mark, ordered by size class, neighbours are tied if their classes allow
    it: if two sets' classes do, so do those of all neighbours between them.
    """
    for bucket, rows in by_bucket(batches):
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([r["ids"] for r in rows], pa.binary())], ["a", "b", "ids"])
            continue
        keys, kinds, ids = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", "<i8"), ("classes", np.uint8), ("ids", "<u4")))
        # most marks are one set's alone
        by_id = np.argsort(ids, kind="stable")
        same = ids[by_id][1:] == ids[by_id][:-1]
        kept = by_id[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        keys, kinds, ids = keys[kept], kinds[kept].astype(np.int64), ids[kept]
        order = np.lexsort((keys, kinds, ids))
        keys, kinds, ids = keys[order], kinds[order], ids[order]
        tie = (ids[1:] == ids[:-1]) & (keys[1:] != keys[:-1]) & (kinds[1:] - kinds[:-1] <= 1)
        pairs = np.unique(np.stack([keys[:-1][tie], keys[1:][tie]], axis=1), axis=0)
        nodes, index = np.unique(pairs, return_inverse=True)
        index = index.reshape(pairs.shape)
        forest = Forest(len(nodes))
        for i, j in index.tolist():
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
        other = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[roots[other]]), pa.nulls(int(other.sum()), pa.binary())], ["a", "b", "ids"])


def _packed_rows(wanted: np.ndarray):
    """(doc, text key, text) with the text's bytes compressed, of the texts that the bitmap wants."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for some in slices(batch.filter(pa.array(_marks(wanted, _place(batch)).astype(bool))), 2, SLICE_BYTES):
                packed = [press.compress((t or "").encode()) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(packed, pa.binary())], ["doc", "text_key", "packed"])

    return rows


def groups_for(size: float) -> int:
    """Hashed groups for sets of about a size: so few shingles in each that unlike sets fall short of the bound."""
    return 1 << max(4, min(13, math.ceil(math.log2(max(1.0, size / 4)))))


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles each group has; of half the groups it is the sum of two halves."""
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups).astype("<u4")


class CountTree:
    """An R-tree over count vectors, bulk-loaded in order of set size and then of the counts.

    A set's vector counts its shingles by hashed group. Two sets share at most the sum, over the
    groups, of the lesser of their counts; a set and any below a node at most that sum with the
    node's greatest counts.
    """

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray) -> None:
        self.sizes = sizes.astype(np.int64)
        self.vectors = vectors.astype(np.uint16 if vectors.max(initial=0) < 1 << 16 else np.uint32)
        # tiles of sizes first, then of the heaviest coordinate: sort-tile-recursive packing
        tile = max(1, math.isqrt(max(1, len(sizes) // FAN))) * FAN
        by_size = np.argsort(self.sizes, kind="stable")
        spread = (self.vectors.astype(np.float32) ** 2).mean(axis=0) - self.vectors.mean(axis=0) ** 2 if len(sizes) < 256 else self.vectors[by_size[:: len(sizes) // 256 + 1]].std(axis=0)
        lead = self.vectors[:, int(spread.argmax())]
        self.order = np.concatenate([t[np.argsort(lead[t], kind="stable")] for t in np.array_split(by_size, max(1, -(-len(sizes) // tile)))])
        self.levels = []  # from the leaves up: (greatest counts, least and greatest size) of each node
        tops, low, high = self.vectors[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(tops) > 1:
            heads = np.arange(0, len(tops), FAN)
            tops, low, high = np.maximum.reduceat(tops, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            self.levels.append((tops, low, high))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> CountTree:
        sizes = np.array([len(x) for x in sets], np.int64)
        groups = min(512, groups_for(float(np.median(sizes))))
        return cls(sizes, np.stack([count_vector(x, groups) for x in sets]))

    def near(self, i: int) -> np.ndarray:
        """The sets, i among them, that are of a size to link with set i, in leaves that the bound allows to."""
        vector, n = self.vectors[i], self.sizes[i]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).reshape(-1)
                nodes = nodes[nodes < len(tops)]
            nodes = nodes[(OVER * low[nodes] <= UNDER * n) & (UNDER * high[nodes] >= OVER * n)]
            bound = np.minimum(np.minimum(vector, tops[nodes]).sum(axis=1, dtype=np.int64), high[nodes])
            least = np.maximum(low[nodes], -(-n * OVER // UNDER))
            nodes = nodes[(OVER + UNDER) * bound >= OVER * (n + least)]
        points = (nodes[:, None] * FAN + np.arange(FAN)).reshape(-1) if self.levels else nodes
        points = self.order[points[points < len(self.order)]]
        return points[(OVER * self.sizes[points] <= UNDER * n) & (UNDER * self.sizes[points] >= OVER * n)]

    def allowed(self, i: int, points: np.ndarray) -> np.ndarray:
        """Those of the sets that the bound allows to link with set i."""
        shared = np.minimum(self.vectors[i], self.vectors[points]).sum(axis=1, dtype=np.int64)
        return points[(OVER + UNDER) * shared >= OVER * (self.sizes[i] + self.sizes[points])]

    def partners(self, i: int) -> np.ndarray:
        """The sets, i among them, that the bound allows to link with set i."""
        return self.allowed(i, self.near(i))


class Groups:
    """Numbered items in groups that join; `label` tells at once which items are in one."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: list[list[int]] = [[i] for i in range(n)]

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []

    def least(self) -> np.ndarray:
        """The least item of each item's group."""
        out = np.arange(len(self.label))
        for held in self.members:
            if len(held) > 1:
                out[held] = min(held)
        return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return UNDER * shared >= OVER * (len(a) + len(b) - shared)


class Exact:
    """Compares one set with many at once: which of them are similar enough.

    Shingles are numbered from 0, so a table tells which of them the one set has.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in sets], np.int64)
        found, number = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(number.astype(np.int32), np.cumsum(sizes)[:-1])
        self.sizes, self.has, self.of = sizes, np.zeros(len(found), bool), -1

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.of != i:
            if self.of >= 0:
                self.has[self.sets[self.of]] = False
            self.has[self.sets[i]] = True
            self.of = i
        sizes = self.sizes[others]
        heads = np.cumsum(sizes) - sizes
        shared = np.add.reduceat(self.has[np.concatenate([self.sets[j] for j in others.tolist()])], heads, dtype=np.int64)
        return UNDER * shared >= OVER * (self.sizes[i] + sizes - shared)


def link(tree: CountTree, verify, left: np.ndarray | None = None, roots: list[int] | None = None) -> Groups:
    """Joins all sets that are linked, directly or through others; verify(i, sets) tells which of what the tree finds are.

    With `left`, only pairs of a left and another set count: the others meet elsewhere. Sets of
    equal `roots` are joined to begin with. Pairs that are joined already are not even looked
    at, and a set meets a few others at first, so a group of near copies takes few comparisons.
    Sets that are alike but not linked are compared many at once.
    """
    n = len(tree.sizes)
    groups = Groups(n)
    firsts: dict[int, int] = {}
    for i, root in enumerate(roots or ()):
        groups.join(i, firsts.setdefault(root, i))
    earlier = np.zeros(n, bool)
    for i in range(n):
        open_ = earlier & (groups.label != groups.label[i])
        if left is not None:
            open_ &= left != left[i]
        if open_.any():
            points, most = tree.near(i), AT_FIRST
            points = points[open_[points]]
            while len(points):
                some, points = tree.allowed(i, points[:most]), points[most:]
                found = some[verify(i, some)] if len(some) else some
                for j in found.tolist():
                    groups.join(i, j)
                if len(found):
                    points = points[groups.label[points] != groups.label[i]]
                else:
                    most *= 2
        earlier[i] = True
    return groups


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows that meet, from rows sorted by their first three columns; few are unpacked at once."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, len(batch), 256):
            for row in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pairs, mine, node, n, groups, packed text) with the text's count vector in its place."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            groups, out = some.column(5).to_pylist(), []
            texts = pa.array([zstandard.decompress(p) for p in some.column(6).to_pylist()], pa.large_binary())
            for row, _, data, bounds in chunks(texts):
                out += [press.compress(count_vector(x, groups[i]).astype("<u4").tobytes()) for i, x in enumerate(shingle_sets(data, bounds, WORDS), row)]
            yield pa.RecordBatch.from_arrays([*some.columns[:6], pa.array(out, pa.binary())], some.schema.names[:6] + ["vector"])


def _bound_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, lesser node) for sets of two tiles whose bound allows a link. Rows: block, left, right, mine, node, n, groups, vector."""
    for rows in _tasks(batches):
        rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
        groups = min(r[6] for r in rows)
        vectors = np.empty((len(rows), groups), np.uint32)
        for i, r in enumerate(rows):
            # two groups of a set are one of half as many groups
            vectors[i] = np.frombuffer(zstandard.decompress(r[7]), "<u4").reshape(-1, groups).sum(axis=0)
        left = None if rows[0][1] == rows[0][2] else np.array([r[3] == r[1] for r in rows])
        least = link(CountTree(np.array([r[5] for r in rows]), vectors), lambda i, some: np.ones(len(some), bool), left).least()
        found = np.flatnonzero(least != np.arange(len(rows)))
        nodes = np.array([r[4] for r in rows], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(nodes[least[found]])], ["a", "b"])


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, root that it is joined with, whether the block was whole) for each task's groups of sets.

    Rows: block, left, right, node, mine, root, packed text, sorted by the first three.
    """
    for rows in _tasks(batches):
        rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: r[5])  # a repeated row of a document is one set
        texts = pa.array([zstandard.decompress(r[6]) for r in rows], pa.large_binary())
        sets = [s for *_, data, bounds in chunks(texts) for s in shingle_sets(data, bounds, WORDS)]
        _, left, right = rows[0][:3]
        sides = None if left == right else np.array([r[4] == left for r in rows])
        least = link(CountTree.of(sets), Exact(sets), sides, [r[5] for r in rows]).least()
        found = {(rows[i][5], rows[j][5]) for i, j in enumerate(least.tolist())}
        found = [(a, b) for a, b in found if a != b]
        arrays = [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([left == WHOLE] * len(found), pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "whole"])


#: The tile of a block that needs no tiles.
WHOLE = -1


def _meet(members: DataFrame, packed: DataFrame, tasks: int) -> DataFrame:
    """(a, b, whole): roots that links join. members: block, left, right, mine, node, root, doc, text_key."""
    held = packed.join(members, ["doc", "text_key"]).select("block", "left", "right", "node", "mine", "root", "packed")
    met = held.repartition(tasks, "block", "left", "right").sortWithinPartitions("block", "left", "right")
    return cut_lineage(arrow_map(met, _link_rows, "a long, b long, whole boolean"))


def _few(plan: DataFrame) -> tuple[DataFrame, int]:
    """A plan with a row for each large block or class, broadcast if it is small, and its rows."""
    plan = cut_lineage(plan)
    rows = plan.count()
    return (F.broadcast(plan) if rows <= FEW else plan), rows


def _tiled(classed: DataFrame) -> DataFrame:
    """The first meeting of large blocks: each set in its tile, and leaders in all tiles of their class."""
    sums = classed.groupBy("block", "class").agg(F.sum("n").alias("total"))
    parts, _ = _few(sums.select("block", "class", F.ceil(F.col("total") / UNIT).alias("parts"), F.ceil(F.col("total") / LEADERS).alias("led")))
    rows = classed.join(parts, ["block", "class"]).withColumn("tile", F.pmod(F.xxhash64("node"), "parts"))
    leads = F.pmod(F.xxhash64("node", F.lit(1)), "led") == 0
    tiles = F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("tile"))
    rows = rows.withColumn("tile", F.explode(tiles)).withColumn("mine", F.col("class") * TILES + F.col("tile"))
    return rows.withColumn("left", F.col("mine")).withColumn("right", F.col("mine"))


def _plus(start: Column):
    return lambda i: start + i


def _paired(classed: DataFrame, unit: int) -> DataFrame:
    """Adds mine, left and right: tiles of sets that are `rest` meet each other's and those of the others.

    Linked sets are in one size class or in neighbouring ones, each class being less than
    UNDER / OVER times as wide as the one before.
    """
    size = lambda kind: F.ceil(F.sum(F.when(kind, F.col("n")).otherwise(0)) / unit)
    parts = cut_lineage(classed.groupBy("block", "class").agg(size(F.col("rest")).alias("rest_0"), size(~F.col("rest")).alias("main_0")))
    beside = parts
    for shift, suffix in ((1, "up"), (-1, "down")):
        other = parts.select("block", (F.col("class") - shift).alias("class"), F.col("rest_0").alias(f"rest_{suffix}"), F.col("main_0").alias(f"main_{suffix}"))
        beside = beside.join(other, ["block", "class"], "left")
    beside, _ = _few(beside)
    rows = classed.join(beside, ["block", "class"])
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), "rest_0")).otherwise(TILES // 2 + F.pmod(F.xxhash64("node"), "main_0"))
    rows = rows.withColumn("mine", F.col("class") * TILES + own)

    def tiles(kind: str, base: int) -> Column:
        """The tiles of a kind, in this size class and the ones beside it."""
        found = []
        for shift, suffix in ((0, "0"), (1, "up"), (-1, "down")):
            numbers = F.when(F.col(f"{kind}_{suffix}") > 0, F.sequence(F.lit(0).cast("long"), F.col(f"{kind}_{suffix}") - 1)).otherwise(F.array().cast("array<bigint>"))
            found.append(F.transform(numbers, _plus((F.col("class") + shift) * TILES + base)))
        return F.concat(*found)

    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    among = F.transform(tiles("rest", 0), lambda u: pair(F.least("mine", u), F.greatest("mine", u)))
    across = F.transform(tiles("main", TILES // 2), lambda u: pair(F.col("mine"), u))
    back = F.transform(tiles("rest", 0), lambda u: pair(u, F.col("mine")))
    return rows.withColumn("pairs", F.when(F.col("rest"), F.concat(among, across)).otherwise(back))


def _outside(classed: DataFrame) -> DataFrame:
    """Adds `rest`: whether a set is outside its block's largest group so far."""
    groups = classed.groupBy("block", "root").agg(F.sum("n").alias("total"))
    largest, _ = _few(groups.groupBy("block").agg(F.max_by("root", F.struct("total", "root")).alias("main")))
    return classed.join(largest, "block").withColumn("rest", F.col("root") != F.col("main"))


def _large(members: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of more than UNIT shingles."""
    return _few(members.groupBy("block").agg(F.sum("n").alias("total")).where(F.col("total") > UNIT).select("block"))


def _classed(members: DataFrame) -> DataFrame:
    return members.withColumn("class", F.floor(F.ln("n") / F.lit(math.log(UNDER / OVER))).cast("long"))


def _sharper(members: DataFrame, packed: DataFrame, tasks: int) -> DataFrame:
    """The members of large blocks in blocks that the count vectors' bound ties; sets it ties to none go."""
    classed = _classed(members)
    groups = F.lit(16)  # as groups_for has it, for the least size of the class
    for bits in range(5, 14):
        groups = F.when(F.pow(F.lit(UNDER / OVER), F.col("class")) / 4 > 1 << (bits - 1), 1 << bits).otherwise(groups)
    paired = _paired(classed.withColumn("rest", F.lit(True)), VECTOR_UNIT).withColumn("groups", groups)
    held = packed.join(paired, ["doc", "text_key"]).select("block", "pairs", "mine", "node", "n", "groups", "packed")
    schema = "block long, pairs array<struct<left:long,right:long>>, mine long, node long, n long, groups int, vector binary"
    held = arrow_map(held, _vector_rows, schema).withColumn("pair", F.explode("pairs"))
    met = held.select("block", "pair.left", "pair.right", "mine", "node", "n", "groups", "vector").repartition(tasks, "block", "left", "right").sortWithinPartitions("block", "left", "right")
    tied = components(arrow_map(met, _bound_rows, "a long, b long"))
    return cut_lineage(members.drop("block").join(tied.withColumnRenamed("root", "block"), "node").select(members.columns))


_MEMBERS = ["block", "left", "right", "mine", "node", "root", "doc", "text_key"]


def _joined(members: DataFrame, packed: DataFrame, tasks: int) -> DataFrame:
    """(node, root) of the sets that links join with a lesser one. packed is read up to four times."""
    whole = F.lit(WHOLE).cast("long")
    in_one = lambda rows: rows.select("*", whole.alias("left"), whole.alias("right"), whole.alias("mine"), F.col("node").alias("root")).select(_MEMBERS)
    large, n_large = _large(members)
    if not n_large:
        return _meet(in_one(members), packed, tasks).select(F.col("a").alias("node"), F.col("b").alias("root"))
    packed = cut_lineage(packed)
    sharper = _sharper(members.join(large, "block", "left_semi"), packed, tasks)
    members = members.join(large, "block", "left_anti").unionByName(sharper)
    large, n_large = _large(sharper)
    if not n_large:
        return _meet(in_one(members), packed, tasks).select(F.col("a").alias("node"), F.col("b").alias("root"))
    classed = _classed(sharper.join(large, "block", "left_semi")).withColumn("root", F.col("node"))
    met = _meet(in_one(members.join(large, "block", "left_anti")).unionByName(_tiled(classed).select(_MEMBERS)), packed, tasks)
    done = met.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = components(met.where("not whole").select("a", "b")).withColumnRenamed("root", "known")
    classed = cut_lineage(classed.join(roots, "node", "left").withColumn("root", F.coalesce("known", "root")).drop("known"))
    pairs = _paired(_outside(classed), UNIT).withColumn("pair", F.explode("pairs")).withColumn("left", F.col("pair.left")).withColumn("right", F.col("pair.right"))
    again = components(_meet(pairs.select(_MEMBERS), packed, tasks).select("a", "b"))
    last = classed.join(again.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    return done.unionByName(last.select("node", F.coalesce("last", "root").alias("root")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, text_key, first.

    A-Z is lower-cased; words are runs of bytes without ASCII white space. A text of fewer than
    WORDS words has its word sequence as its one shingle; a text without words, null among them,
    has none, links with nothing and is its own component. component_id is the least id that
    links lead to. A null id counts as larger than all others and comes back as null, alone or
    as a component's name only if no other id is in it. Repeated rows have equal sets. text_key
    tells the texts of one id apart; `first` marks one (id, text) of each component, with its
    least id, and each row that repeats it. Other columns are not read. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(doc_key(id_col).alias("doc"), text_key(text).alias("text_key"), text.alias("text"))
    n_rows, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = -(-size // BUCKET_BYTES) or 1
    repeated = bitmap(rows.select("text"), _repeated, n_rows)
    dealt = arrow_map(rows, _prefix_rows(repeated, buckets), _DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = cut_lineage(arrow_map(dealt, _block_rows, "a long, b long, ids binary"))
    narrow = arrow_map(met.where("ids IS NOT NULL").select("ids"), _narrow_rows, "doc long, text_key long, node long, check long, n long")
    sets = narrow.where("n > 0").groupBy("node", "check").agg(F.min(F.struct("doc", "text_key")).alias("least"), F.min("n").alias("n"))
    blocks = components(met.where("ids IS NULL").select("a", "b")).withColumnRenamed("root", "block")
    members = cut_lineage(blocks.join(sets, "node").select("block", "node", "n", "least.doc", "least.text_key"))
    wanted = bitmap(members.select("doc", "text_key"), _wanted, members.count())
    packed = arrow_map(rows, _packed_rows(wanted), "doc long, text_key long, packed binary")
    joined = _joined(members, packed, buckets)

    named = sets.join(joined, "node", "left").select("node", "check", F.coalesce("root", "node").alias("root"), "least")
    firsts = named.groupBy("root").agg(F.min("least").alias("of"))
    named = narrow.join(named.join(firsts, "root").select("node", "check", "of"), ["node", "check"], "left")
    known = lambda c: F.when(F.col(c) != F.lit((1 << 63) - 1), F.col(c))
    first = F.coalesce((F.col("doc") == F.col("of.doc")) & (F.col("text_key") == F.col("of.text_key")), F.lit(True))
    return named.select(
        known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("of").isNull(), known("doc")).otherwise(known("of.doc")).alias("component_id"),
        "text_key", first.alias("first"),
    )


def text_key(text: Column) -> Column:
    """What tells the texts of one document id apart."""
    return F.xxhash64(text)
