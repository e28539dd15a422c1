"""Packing, BPE, language, quality, sharding and license scans against plainer versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from quillmere.llm import bpe, language, licenses, packing, quality_classifier, quality_rules, sharding
from quillmere.llm.common import chunks, documents, global_rank

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a  b", "\n", " a", "a ", "x \ny", "<|endoftext|> z", "日本 語", "a½²b c", "it's 's x'll", "\x1c a b", "a\x85b c", "café ñ\n\nb", "🙂 áb"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_packing_leaves_other_files_to_the_library(tmp_path, tokenizer):
    import json

    file = json.load(open(JSON))
    assert packing._agrees(JSON)
    file["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    assert not packing._agrees(str(other))
    from tokenizers import Tokenizer

    ids = packing.Ids(str(other), packing._agrees(str(other)))
    assert ids("a plain text").tolist() == Tokenizer.from_file(str(other)).encode("a plain text", add_special_tokens=False).ids


def test_packed_ids_are_the_tokenizers(tokenizer):
    ids = packing.Ids(JSON)
    assert ids.agrees()
    draw = random.Random(1)
    plain = [chr(c) for c in [10, *range(32, 127), *range(0xA1, 0x250)]]
    texts = ODD + ["".join(draw.choice(plain) for _ in range(draw.randint(0, 40))) for _ in range(3_000)]
    for text in texts:
        assert ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_is_gapless_and_close_to_the_bound():
    draw = np.random.default_rng(0)
    lengths = np.clip(draw.lognormal(5, 1.2, 20_000).astype(int), 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    sequences = collections.defaultdict(list)
    placed = collections.Counter()
    for length, low, high, first, each, offset in packing.plan(histogram):
        for i in range(high - low):
            sequences[first + i // each].append((offset + i % each * length, length))
            placed[length] += 1
    assert placed == histogram
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= lengths.sum() / 2048 * 1.01 + 1


def test_packing(frame, odd_rows, tokenizer):
    found = packing.pack(frame(odd_rows), JSON, most=64).collect()
    expected = collections.Counter()
    for doc, text in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in found) == expected
    by = collections.defaultdict(list)
    for row in found:
        by[row.sequence_id].append((row.offset, row.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame([]), JSON).collect() == []


def test_bpe_equals_tiktoken(tiktoken_encoding):
    encoder = bpe.BytePairEncoder(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(2)
    letters = "aaab the1234 \n\t\x1c\x85é²日's..!!  "
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(4_000)]
    texts += ["a" * 5_000, "ab" * 4_000, " " * 3_000, "".join(draw.choice("abcdefgh") for _ in range(20_000))]
    for ids, text in zip(encoder.encode(texts), texts, strict=True):
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
    every = [f"a{chr(c)}1{chr(c)} {chr(c)}!  {chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert encoder.encode(every) == [tiktoken_encoding.encode_ordinary(t) for t in every]


def test_rank_queue_gives_the_lowest_first():
    draw = random.Random(4)
    queue, waiting = bpe.RankQueue(50_256), {}
    for _ in range(2_000):
        rank = draw.randrange(50_256)
        if rank not in waiting:
            queue.open(rank, [rank])
            waiting[rank] = [rank]
        if draw.random() < 0.5:
            low = min(waiting)
            assert queue.take() == (low, waiting.pop(low))
    assert [queue.take()[0] for _ in range(len(waiting))] == sorted(waiting) and not queue.top


def test_bpe_round_trip(frame, odd_rows, tiktoken_encoding):
    found = sorted((tuple(r) for r in bpe.round_trip(frame(odd_rows), RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    expected = []
    for doc, text in odd_rows:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=repr)
    ids = bpe.encode(frame(odd_rows), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in odd_rows)


def test_viterbi_is_the_best_path():
    import itertools

    draw = np.random.default_rng(0)
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(draw.integers(0, 6, 4))])
        scores = draw.normal(0, 5, (first[-1], 3)).astype(np.float32)
        path = language.viterbi(scores, first, 2.0)
        for a, b in zip(first, first[1:], strict=False):
            value = lambda p: sum(scores[a + i, p[i]] for i in range(b - a)) - 2 * sum(p[i] != p[i + 1] for i in range(b - a - 1))  # noqa: B023, E731
            if b > a:
                assert value(path[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-3)


def test_scripts_narrow_and_spans_are_offsets():
    pairs = [("the house and the street of the town", "en"), ("le château et la rue de la ville", "fr"), ("дом и улица в городе большой", "ru")]
    model = language.learn(iter(pairs * 20))
    names, scores, spans = language.label(model, ["", "12 !?", "улица", "the house et la ville", "дом the street of the town"])
    assert names[:3] == ["und", "und", "ru"] and scores[:3] == [0, 0, 1]
    assert spans[4][0] == {"start": 0, "end": 3, "lang": "ru"}
    assert names[4] == "en" and 0 < scores[4] < 1


def test_language_on_held_out_documents(spark, frame, odd_rows):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    nothing = language.identify(frame(odd_rows)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(odd_rows)
    assert language.identify(frame([])).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_base_counts(odd_rows, most):
    draw = random.Random(6)
    texts = [t or "" for _, t in odd_rows] + ["".join(draw.choice(["a ", "b ", "é ", "\n", "# ", "a\x85b", "\t", "the end "]) for _ in range(draw.randint(0, 80))) for _ in range(800)]
    found = []
    for _, _, data, bounds in chunks(pa.array(texts), most):
        counts = quality_rules.base_counts(data, bounds)
        found += zip(*(counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert found == [brute_counts(t) for t in texts]


@pytest.mark.parametrize("what", ["rules", "classifier"])
def test_quality_on_held_out_documents(spark, what):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), documents(spark, "/root/testdata/sf0.1", "labels")
    known = labels.where(quality_rules.fold() == quality_rules.HELD_OUT)
    if what == "rules":
        rows = quality_rules.judge(docs, labels).join(known, "doc_id").where("n_words >= 10").selectExpr("int(kept) AS good", "quality").collect()
    else:
        rows = quality_classifier.classify(docs, labels).join(known, "doc_id").selectExpr("predicted AS good", "quality").collect()
    assert np.mean([r.good == r.quality for r in rows]) > 0.97
    assert np.mean([r.good for r in rows if r.quality == 1]) > 0.97


def test_quality_without_labels_and_of_odd_rows(spark, frame, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 1), (0, None), (99_999, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        judged = quality_rules.judge(frame(odd_rows), labels).collect()
        assert len(judged) == len(odd_rows) and all(r.kept != r.base_failed for r in judged)
        scored = quality_classifier.classify(frame(odd_rows), labels).collect()
        assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality_classifier.classify(frame(odd_rows), none).collect()} == {0.5}
    kept = quality_rules.keep_good(frame(odd_rows), none)
    assert kept.columns == frame([]).columns
    assert kept.count() == sum(r.kept for r in quality_rules.judge(frame(odd_rows), none).collect())
    assert quality_rules.judge(frame([]), none).collect() == []
    assert quality_classifier.classify(frame([]), none).collect() == []


def test_sharding(frame, spark, odd_rows):
    found = sharding.shard(frame(odd_rows), 4).collect()
    expected = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in odd_rows)
    assert collections.Counter(tuple(r[:3]) for r in found) == expected
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard(frame([]), 4).collect() == []
    docs = sharding.shard(documents(spark, "/root/testdata/sf0.01")).collect()
    size, rows = np.zeros(16), np.zeros(16)
    for r in docs:
        size[r.shard] += r["size"]
        rows[r.shard] += 1
    assert size.max() - size.min() <= 0.05 * size.mean() and rows.max() - rows.min() <= 0.1 * rows.mean()


def test_bundles_of_small_groups_balance_as_groups_do(frame, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdef") * draw.randint(1, 9) for _ in range(draw.randint(1, 40)))) for i in range(4_000)]
    for bundles in (256, 1 << 14):
        monkeypatch.setattr(sharding, "BUNDLES", bundles)
        by_text = collections.defaultdict(set)
        size = np.zeros((8, 2))
        for r in sharding.shard(frame(rows), 8).collect():
            by_text[r.text_crc32].add(r.shard)
            size[r.shard] += (r["size"], 1)
        assert all(len(s) == 1 for s in by_text.values())
        assert ((size.max(axis=0) - size.min(axis=0)) / size.mean(axis=0)).max() < 0.05


def test_a_group_larger_than_a_shard_is_dealt_over_several(frame):
    rows = [(i, "same text") for i in range(600)] + [(1_000 + i, f"other {i % 7} {'x' * (i % 50)}") for i in range(1_200)]
    found = sharding.shard(frame(rows), 4).collect()
    size = np.zeros(4)
    for r in found:
        size[r.shard] += r["size"]
    assert size.max() - size.min() <= 0.05 * size.mean()
    # where the law allows it, equal texts stay together
    together = collections.defaultdict(set)
    for r in found:
        if r.doc_id >= 1_000:
            together[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in together.values())


def test_global_rank_of_a_hot_key(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i // 2) for i in range(500)], "k long, v long")
    found = global_rank(rows, ["k"], ["v"], "r", rows_per_task=20).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.k].append(r.r)
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in by.values())


def test_winnowing_keeps_one_of_every_window():
    draw = np.random.default_rng(1)
    grams = draw.integers(0, 1 << 40, 200).astype(np.uint64)
    kept = licenses.winnow(grams)
    assert all(any(at <= k < at + licenses.WINDOW for k in kept) for at in range(len(grams) - licenses.WINDOW + 1))


def brute_match(template, text):
    """The longest common subsequence of the template with any stretch of the text."""
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if a == b else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_alignment_matches_as_many_words_as_any_within_the_band():
    draw = random.Random(8)
    for _ in range(150):
        template = [draw.randint(0, 30) for _ in range(draw.randint(3, 14))]
        text = list(template)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = [99] * draw.randint(0, 2)
        found, begin, end = licenses.align(np.array(template), np.array([77] * 4 + text + [78] * 4), 4)
        assert found == brute_match(template, text)
        assert 0 <= begin <= end <= len(text) + 8


def test_license_scan(frame):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    long = licenses.TEMPLATES["MIT"][1]
    edited = long.replace("free of charge", "gratis and free").replace("any person", "a person").upper()
    rows = [(1, f"é text {mit} more"), (2, f"{gpl}\n{mit}"), (3, None), (4, ""), (None, "the license of"), (5, f"x {edited}"), (5, f"x {edited}"), (6, "word " * 5_000 + mit)]
    found = {(r.doc_id, r.n_matches): r for r in licenses.scan_licenses(frame(rows)).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 0), (4, 0), (None, 0), (5, 1), (6, 1)}
    one = found[1, 1].matches[0]
    assert rows[0][1].encode()[one.start : one.end].decode() == mit.rstrip(".") and one.coverage == 1
    assert [m.license for m in found[2, 2].matches] == ["GPL-3.0", "MIT"]
    assert found[5, 1].license == "MIT" and 0.8 <= found[5, 1].coverage < 1
    assert licenses.scan_licenses(frame([])).collect() == []


LICENSED = [
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    *((text, name) for name, text in licenses.FULL_TEXTS.items()),
]


@pytest.mark.parametrize(("text", "name"), LICENSED, ids=[f"{n}-{len(t)}" for t, n in LICENSED])
def test_licenses_have_their_own_names_and_whole_spans(text, name):
    data = f"before it {text} and after".encode()
    found = licenses.scan(licenses.Index(licenses.TEMPLATES), np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert [(m["license"], m["coverage"]) for m in found] == [(name, 1.0)]
    assert found[0]["end"] - found[0]["start"] > 0.99 * len(text.encode()) - 2


def test_scan_finds_every_planted_notice():
    draw = random.Random(12)
    index = licenses.Index(licenses.TEMPLATES)
    notices = [*LICENSED[:7], ("Released under the MIT License.", "MIT"), ("Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-NC-4.0")]
    for trial in range(120):
        planted, text = [], []
        for _ in range(draw.randint(0, 6)):
            notice, name = draw.choice(notices[-2:] if trial % 3 == 0 else notices)
            text += [f"w{draw.random()}"] * draw.choice([0, 0, 1, 2, 9])
            planted.append(name)
            text.append(notice)
        data = " ".join([*text, "end"]).encode()
        found = licenses.scan(index, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert [m["license"] for m in found] == planted
        assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(("text", "times"), [("Released under the MIT License. ", 3), ("Released under the MIT License. x y ", 4), ("Creative Commons Attribution-NonCommercial 4.0 International ", 2)])
def test_scan_finds_adjacent_notices(text, times):
    data = (text * times).encode()
    assert len(licenses.scan(licenses.Index(licenses.TEMPLATES), np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]) == times


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, quality int")
    rows = quality_rules.labelled_sample(docs, labels, "quality", 10).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2]
    monkeypatch.setattr(quality_rules, "SAMPLE_BYTES", 7)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 3, "text": "a" * 5, "label": 1}, {"doc_id": 2, "text": "b" * 5, "label": 1}, {"doc_id": 1, "text": "cc", "label": 0}])
    assert [r["doc_id"] for r in quality_rules.sample_rows(iter([batch]))] == [1, 3]


def test_character_trigrams_are_of_code_points():
    texts = ["a\u00e9\u65e5\U0001F642b", "", "xy", "\u00e9" * 4]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    values, first = quality_rules.characters(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert np.diff(first).tolist() == [len(t) for t in texts]
    joined = "".join(texts)
    assert all((values[i] == values[j]) == (joined[i] == joined[j]) for i in range(len(joined)) for j in range(len(joined)))
    grams = quality_rules.features(np.frombuffer(b"".join(raw), np.uint8), bounds)[2]
    assert np.diff(grams[1]).tolist() == [max(0, len(t) - 2) for t in texts]


def test_a_very_long_text_goes_through_every_text_operator(spark):
    draw = random.Random(1)
    vocabulary = [f"word{i}" for i in range(3_000)]
    long = " ".join(draw.choice(vocabulary) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "short one", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs, none).collect()} == {1: 400_000, 2: 2}
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"en"}
    assert quality_classifier.classify(docs, none).count() == 2
    assert {r.n_matches for r in licenses.scan_licenses(docs).collect()} == {0}
