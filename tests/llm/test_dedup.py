"""Exact dedup, the Jaccard join and suffix dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillmere.llm import exact_dedup, jaccard_join, suffix_dedup
from quillmere.llm.components import components
from quillmere.llm.jaccard_join import CountTree, linked
from quillmere.llm.textscan import shingle_sets

LAST = (1 << 63) - 1
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cuckoo_index_against_a_dict():
    draw = random.Random(0)
    index, expected = exact_dedup.CuckooIndex(2), {}
    for step in range(20_000):
        key = hashlib.sha256(str(draw.randint(0, 3_000)).encode()).digest()
        if draw.random() < 0.6:
            if index.find(key) is None:
                index.insert([key, step, 1])
                expected[key] = step
        else:
            assert index.delete(key) == (expected.pop(key, None) is not None)
        assert (index.find(key) is not None) == (key in expected)
    assert {e[0]: e[1] for e in index.entries()} == expected
    assert index.size == len(expected) and index.mask > 1
    assert exact_dedup.withdraw(index, iter(list(expected)[:10] + [b"absent" * 6])) == 10


def test_exact_dedup(frame, odd_rows):
    groups = collections.defaultdict(list)
    for doc, text in odd_rows:
        groups[text or ""].append(doc)
    expected = []
    for doc, text in odd_rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(frame(odd_rows))) == sorted(expected, key=repr)
    assert rows_of(exact_dedup.exact_dedup(frame([]))) == []


def brute_removal(rows):
    key = lambda d: LAST if d is None else d
    first: dict[bytes, int] = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], LAST), key(doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key(doc):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "hot_from"), [(1, 20_000), (2, 3)])
def test_suffix_dedup(frame, seed, hot_from):
    from llm_rows import make_rows

    rows = make_rows(seed)
    found = suffix_dedup.remove_repeats(frame(rows), hot_from=hot_from).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    assert sorted(((*r[:5], bytes(r[5])) for r in found.collect()), key=repr) == brute_removal(rows)


def test_suffix_dedup_of_nothing(frame):
    assert rows_of(suffix_dedup.remove_repeats(frame([]))) == []


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0\xff"])
def test_suffix_sorter_orders_and_finds_repeats(monkeypatch, alphabet):
    draw = random.Random(len(alphabet))
    for block in (3, 50, 10_000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        segments = [bytes(draw.choice(alphabet) for _ in range(draw.randint(1, 130))) for _ in range(7)]
        segments += [segments[0][:70], segments[0][3:] + b"z"]
        sizes = np.array([len(s) for s in segments])
        docs = np.array([draw.randint(0, 4) for _ in segments])
        least: dict[bytes, int] = {}
        for doc, s in zip(docs.tolist(), segments, strict=True):
            for i in range(len(s) - 49):
                least[s[i : i + 50]] = min(least.get(s[i : i + 50], 99), doc)
        expected = [len(s) - i >= 50 and least[s[i : i + 50]] < d for d, s in zip(docs.tolist(), segments, strict=True) for i in range(len(s))]
        assert suffix_dedup.repeated_windows(docs, sizes, np.frombuffer(b"".join(segments), np.uint8)).tolist() == expected


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    key = lambda d: LAST if d is None else d
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * union:
            parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), LAST), key(doc))
    name = lambda x: None if x == LAST else x
    return sorted(((d, len(s), name(least[root(i)]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_rows(seed):
    draw = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (None, "ONE two"), (4, " \n")]
    for _ in range(12):
        base = [draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(draw.randint(3, 200))]
        for _ in range(draw.randint(1, 9)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                words[draw.randrange(len(words))] = str(draw.random())
            rows.append((len(rows) + 5, " ".join(words)))
    return rows + rows[10:12] + [(1_000, rows[20][1])]


def groups_of(df):
    return rows_of(jaccard_join.similar_groups(df).select("doc_id", "n_shingles", "component_id"))


def chain_rows(seed):
    """One large block: a large group, sets that are near it but not linked, and small groups among those."""
    draw = random.Random(seed)
    base = [str(draw.random()) for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(0, 120, 6), draw.choice([0, 1, 1, 2, 3, 4])):
            words[at] = draw.choice("abc") + str(at)
        rows.append((draw.randrange(1_000) * 100 + i, " ".join(words[draw.randint(0, 6) :])))
    return rows


@pytest.mark.parametrize(("unit", "leaders"), [(1 << 18, 1 << 15), (300, 150), (100, 10)])
def test_jaccard_join(frame, monkeypatch, unit, leaders):
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    monkeypatch.setattr(jaccard_join, "VECTOR_UNIT", unit)
    rows = near_rows(unit % 7) + [(d + 10_000, t) for d, t in chain_rows(unit)]
    assert groups_of(frame(rows)) == brute_groups(rows)


def test_jaccard_join_of_odd_rows_and_of_nothing(frame, odd_rows):
    assert groups_of(frame(odd_rows)) == brute_groups(odd_rows)
    assert groups_of(frame([])) == []


def test_jaccard_join_marks_one_text_of_each_component(frame):
    copy = " ".join(map(str, range(60)))
    rows = [(1, copy), (5, copy + " extra"), (5, "quite other words stand here now"), (None, ""), (7, None), (9, copy), (9, copy)]
    found = [(r.doc_id, r.component_id, r.first) for r in jaccard_join.similar_groups(frame(rows)).collect()]
    assert sorted(found, key=repr) == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (None, None, True), (7, 7, True), (9, 1, False), (9, 1, False)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_share_a_mark(seed):
    draw = np.random.default_rng(seed)
    repeated = draw.integers(0, 256, 1 << 7).astype(np.uint8)
    fresh = lambda n: draw.integers(0, 1 << 64, n, dtype=np.uint64)
    for n in [*range(1, 140), 255, 256, 257, 1_000, 5_000]:
        a = np.unique(fresh(n))
        # as unlike as linked sets can be: `gone` shingles go, and as many come as the bound allows
        for gone in {0, n // 9, n // 5, int(draw.integers(0, n // 5 + 1))}:
            more = max(0, (n - gone) * 5 // 4 - n)
            b = np.unique(np.concatenate([draw.permutation(a)[gone:], fresh(more)]))
            assert linked(a, b)
            if len(a) != len(b) or (a != b).any():
                assert np.intersect1d(jaccard_join.prefix(a, repeated), jaccard_join.prefix(b, repeated)).size


def test_jaccard_join_ties_no_long_texts_that_share_a_few_passages(frame, monkeypatch):
    # neighbours share 20 of some 800 shingles, so single ones would tie them all
    draw = random.Random(8)
    passages = [" ".join(str(draw.random()) for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join([*(str(draw.random()) for _ in range(700)), *passages[i * 10 : i * 10 + 20]])) for i in range(30)]
    rows += [(100 + i, t + " end") for i, t in rows[:2]]
    met = []
    meet = jaccard_join._joined
    monkeypatch.setattr(jaccard_join, "_joined", lambda members, *rest: met.append(members.count()) or meet(members, *rest))
    assert groups_of(frame(rows)) == brute_groups(rows)
    assert 4 <= met[0] <= 12  # of 32


def test_sorter_holds_few_bytes_for_each_suffix():
    data = np.random.default_rng(0).integers(0, 3, 2_000_000).astype(np.uint8)
    stops = np.arange(99, 2_000_000, 100)
    data[stops] = 0
    sorter = suffix_dedup.SuffixSorter(data, stops)
    assert sum(x.nbytes for x in (sorter.padded, sorter.segment, sorter.rank, sorter.stops)) < 7 * len(data)


def test_count_tree_misses_no_partner():
    texts = [(t or "").encode() for _, t in near_rows(5)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sets = [s for s in shingle_sets(np.frombuffer(b"".join(texts), np.uint8), bounds) if len(s)]
    tree = CountTree.of(sets * 3)
    for i, a in enumerate(sets):
        assert {j for j, b in enumerate(sets * 3) if linked(a, b)} <= set(tree.partners(i).tolist())


@pytest.mark.parametrize("two_tiles", [False, True])
def test_alike_sets_are_linked_in_few_steps(two_tiles):
    """A large group of near copies and as many texts that are alike but not linked, as in a growing cluster."""
    draw = np.random.default_rng(7)
    base = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for i in range(600):
        gone = draw.integers(0, 20) if i % 2 else draw.integers(50, 90)  # two of the latter have 6 to 7 of 10 shingles in common
        sets.append(np.unique(np.concatenate([draw.permutation(base)[gone:], draw.integers(0, 1 << 63, gone, dtype=np.uint64)])))
    left = np.arange(600) % 3 == 0 if two_tiles else None
    roots = [i - i % 150 if i % 4 == 1 else i for i in range(600)]
    expected = jaccard_join.Forest(600)
    first = {}
    for i, root in enumerate(roots):
        expected.join(i, first.setdefault(root, i))
    for i, j in itertools.combinations(range(600), 2):
        if (left is None or left[i] != left[j]) and linked(sets[i], sets[j]):
            expected.join(i, j)
    tree, exact, asked, met = CountTree.of(sets), jaccard_join.Exact(sets), [], []

    def verify(i, others):
        asked.append(len(others))
        found = exact(i, others)
        assert found.tolist() == [linked(sets[i], sets[j]) for j in others.tolist()]
        return found

    found = jaccard_join.link(tree, verify, left, roots).least().tolist()
    assert found == [expected.root(i) for i in range(600)]
    assert 100 < len(set(found)) < 500
    assert len(asked) <= 5 * 600 and max(asked) <= 600  # one pair at a time took tens of thousands of calls

    def any_of(i, others):
        met.append(len(others))
        return np.ones(len(others), bool)

    near = [sets[i] for i in range(1, 600, 2)]
    assert set(jaccard_join.link(CountTree.of(near), any_of).least()) == {0}
    assert sum(met) <= jaccard_join.AT_FIRST * len(near)  # the square of them before


def test_components(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(40)] + [(500, 900 + i) for i in range(50)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    expected = {x: root(x) for x in parent if x not in alone}
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == expected
