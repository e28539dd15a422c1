"""The pipeline's stages, each on its own input, against plainer versions."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from quillmere.llm import quality_rules
from quillmere.llm.common import documents, written
from test_dedup import LAST, brute_groups, brute_removal, shingles

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage is given, and what it returns."""
    docs, out = documents(spark, SF_DIR), []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF_DIR))
        out.append((name, docs, result))
        docs = result
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(stages, spark):
    for _, docs, result in stages[:-1]:
        assert result.columns == docs.columns
        assert 0 < result.count() <= docs.count()


def test_quality(stages, spark):
    _, docs, result = stages[0]
    kept = {r.doc_id for r in quality_rules.judge(docs, documents(spark, SF_DIR, "labels")).where("kept").collect()}
    assert set(texts(result)) == kept


def test_exact(stages):
    _, docs, result = stages[1]
    last: dict[str, int] = {}
    for doc, text in texts(docs).items():
        last[text] = max(doc, last.get(text, -1))
    assert texts(result) == {d: t for t, d in last.items()}


def test_near(stages):
    _, docs, result = stages[2]
    assert set(texts(result)) == {d for d, _, c in brute_groups(list(texts(docs).items())) if d == c}


def test_passages(stages):
    _, docs, result = stages[3]
    left = {d: kept.decode("utf-8", "ignore") for d, n, gone, _, _, kept in brute_removal(list(texts(docs).items())) if not gone or kept.decode("utf-8", "ignore")}
    assert texts(result) == left
    assert all(r.n_chars == len(r.text) for r in result.collect())


def test_packing_holds_every_document(stages):
    _, docs, result = stages[4]
    rows = result.collect()
    assert {r.doc_id for r in rows} == set(texts(docs))
    sums = collections.Counter()
    for r in rows:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 2048


def brute_exact(rows):
    last = {}
    for doc, text in rows:
        ids = last.setdefault(text or "", set())
        ids.add(-1 if doc is None else doc)
    kept = {(max(ids), text) for text, ids in last.items()}
    return sorted(((None if d == -1 else d, t) for d, t in kept), key=repr)


def test_exact_of_odd_rows(spark, frame, odd_rows):
    found = corpus_pipeline.exact(spark, frame(odd_rows), SF_DIR)
    assert sorted(((r.doc_id, r.text or "") for r in found.collect()), key=repr) == brute_exact(odd_rows)


def test_near_of_odd_rows(spark, frame, odd_rows):
    """One text of each component stays, with its least id; texts without words all stay."""
    found = [(r.doc_id, r.text or "") for r in corpus_pipeline.near(spark, frame(odd_rows), SF_DIR).collect()]
    groups = brute_groups(odd_rows)
    worded = {c for _, n, c in groups if n}
    empty = {(d, t or "") for d, t in odd_rows if not (t or "").split()}
    assert len(found) == len(set(found))
    assert {f for f in found if not f[1].split()} == empty
    kept = [d for d, t in found if t.split()]
    assert set(kept) == worded
    names = collections.Counter(corpus_groups(odd_rows))
    assert collections.Counter(kept) == names


def corpus_groups(rows):
    """The least id of each component of texts with words."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, a) in enumerate(sets):
        if a:
            least[root(i)] = min(least.get(root(i), LAST), LAST if doc is None else doc)
    return [None if x == LAST else x for x in least.values()]


def test_near_tells_texts_of_one_id_apart(spark, frame):
    copy = " ".join(map(str, range(60)))
    rows = [(1, copy), (5, copy + " extra"), (5, "quite other words stand here now"), (5, "quite other words stand here now")]
    found = corpus_pipeline.near(spark, frame(rows), SF_DIR)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, copy), (5, "quite other words stand here now")]


def test_passages_of_odd_rows(spark, frame, odd_rows):
    found = corpus_pipeline.passages(spark, frame(odd_rows), SF_DIR)
    expected = []
    whole = collections.Counter((d, t or "") for d, t in odd_rows)
    lost = {(d, n, sha): (gone, kept) for d, n, gone, _, sha, kept in brute_removal(odd_rows)}
    for doc, text in odd_rows:
        n = len((text or "").encode())
        gone, kept = next((g, k) for (d, m, s), (g, k) in lost.items() if d == doc and m == n and (g or k.decode() == (text or "")))
        kept = kept.decode("utf-8", "ignore")
        if not gone:
            expected.append((doc, text))
        elif kept:
            expected.append((doc, kept))
    assert sum(whole.values()) == len(odd_rows)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_quality_and_packing_of_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    verdicts = quality_rules.judge(docs, documents(spark, SF_DIR, "labels")).where("kept")
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in verdicts.collect())
    packed = corpus_pipeline.pack(spark, docs, SF_DIR)
    assert packed.where("start = 0").count() == len(odd_rows)


def test_stages_keep_clashing_columns_and_take_no_rows(spark, odd_rows):
    schema = "doc_id long, text string, row string, key string, text_key string, digest string, kept string, nth int, _keep_id string, first string, n_chars long"
    rows = [(d, t, *["own"] * 5, 3, "own", "own", None) for d, t in odd_rows]
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, spark.createDataFrame(rows, schema), SF_DIR)
        assert found.columns == [c.split()[0] for c in schema.split(", ")]
        assert {(r.row, r.key, r.text_key, r.digest, r.kept, r.nth, r._keep_id, r.first) for r in found.collect()} == {(*["own"] * 5, 3, "own", "own")}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF_DIR).count() == 0


def test_run_is_the_stages_in_turn(stages, spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() == stages[-1][2].count()
    assert np.all([r.length > 0 for r in rows.select("length").collect()])
