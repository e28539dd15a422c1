"""Edge cases of single operators on rows made by hand."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.components import components
from quillmere.functions.hot import join_hot
from quillmere.functions.text import counted_words, normalised, sentences
from quillmere.functions.transformers import TagStripper, TokenJoiner, TokenTransformer
from quillmere.operators import edges, models, summary, text, warehouse
from quillmere.operators.models import optics_order, sgd_logistic
from quillmere.plans import jobs
from quillmere.sources import images
from quillmere.streaming import queries as streaming


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "kept", "strict"),
    [
        ("A b. C", ["A b", "C"], ["A b"]),
        ("no end", ["no end"], []),
        ("...", [], []),
        ("one\ntwo. three!\n\nfour?", ["one two", "three", "four"], ["one two", "three", "four"]),
        ("", [], []),
    ],
)
def test_sentences(spark, value, kept, strict):
    assert one(spark, sentences(F.col("text")), value) == kept
    assert one(spark, sentences(F.col("text"), strict=True), value) == strict


def test_words_of_pairs(spark):
    assert one(spark, normalised(F.col("text")), " Été 12 a_b! ") == " t  a_b "
    assert one(spark, counted_words(F.col("text")), "The cat, the CAT and is go 123 dog") == ["cat", "cat", "dog"]


def test_pairs_count_positions_of_different_words(spark):
    docs = spark.createDataFrame([(1, "cat dog cat. bird cat"), (2, "dog cat"), (3, None)], "doc_id long, text string")
    found = {(r.w1, r.w2): r.n for r in text.word_pairs(docs).collect()}
    assert found == {("cat", "dog"): 3, ("bird", "cat"): 1}


def test_joins_agree_and_top_breaks_ties_by_pair(spark):
    first = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 1, 5), (9, 9, 1)], "prev long, curr long, n long")
    second = spark.createDataFrame([(1, 1, 7), (1, 1, 8), (2, 1, 1), (9, 9, 3)], "prev long, curr long, n long")
    top = edges.top_pairs(first, 3)
    assert [tuple(r) for r in top.orderBy("prev", "curr").collect()] == [(1, 1, 5), (1, 2, 5), (2, 1, 5)]
    left, right = edges.broadcast_join(top, second), edges.shuffle_join(top, second)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect())) == [(1, 1, 7), (1, 1, 8), (2, 1, 1)]


@pytest.mark.parametrize(
    ("born", "years"), [("1.6.2000", 18), ("2.6.2000", 17), ("29.2.1985", 33), ("31.2.2000", None), ("18.11", None), ("", None), (None, None), ("x 1.1.2000", None)]
)
def test_age(spark, born, years):
    assert one(spark, warehouse.age(F.col("text")), born) == years


def test_user_whose_posts_are_null_has_the_empty_string(spark):
    users = spark.createDataFrame([(1, None, None, None, None, None), (2, None, None, None, None, None)], "id long, age int, activities string, about string, music string, sex int")
    posts = spark.createDataFrame([(1, None), (1, None)], "from_id long, post string")
    assert {r.id: r.posts for r in warehouse.users_with_posts(users, posts).collect()} == {1: "", 2: None}


def test_summary_merges_in_any_order(spark):
    rows = spark.createDataFrame([(f"t{i % 3}", i % 5) for i in range(50)], "tag string, sentiment int")
    whole = sorted(map(tuple, summary.summarise(rows).collect()))
    for parts in (2, 3):
        pieces = [summary.summarise(rows.where(f"pmod(hash(sentiment, tag), {parts}) = {p}")).drop("mean") for p in range(parts)]
        merged = pieces[-1]
        for piece in reversed(pieces[:-1]):
            merged = summary.merge(merged.drop("mean"), piece)
        assert sorted(map(tuple, merged.collect())) == whole


def test_transformers_check_types_and_can_be_saved(spark, tmp_path):
    rows = spark.createDataFrame([("<p>Some <b>text</b></p>",)], "html string")
    stripped = TagStripper(inputCol="html", outputCol="text").transform(rows)
    assert stripped.first()["text"] == "Some text"
    tokens = TokenTransformer(inputCol="text", outputCol="tokens")
    tokens.write().overwrite().save(str(tmp_path / "tokens"))
    again = TokenTransformer.load(str(tmp_path / "tokens")).transform(stripped)
    assert TokenJoiner(inputCol="tokens", outputCol="joined").transform(again).first()["joined"] == "some text"
    with pytest.raises(TypeError):
        TokenJoiner(inputCol="text", outputCol="joined").transform(stripped)


def test_streams_equal_batches(spark, sf_dir):
    from quillmere.plans import catalog

    batch = sorted(map(tuple, catalog.QUERIES["watched_summary"](spark, sf_dir).collect()))
    for name in ("stream_sentiment_summary", "stream_reinit"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect())) == batch


def test_month_reads_only_its_columns_and_pushes_the_range(spark, sf_dir):
    from quillmere.sources.tables import table

    plan = edges.month(table(spark, sf_dir, "lineitem"), 1998)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_sgd_learns_and_optics_walks_every_point():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 3))
    _, losses = sgd_logistic(x, (x[:, 0] > 0).astype(float), epochs=4)
    assert losses[-1] < losses[0] < 0.7
    points = np.concatenate([draw.normal(0, 0.1, (20, 2)), draw.normal(5, 0.1, (20, 2))])
    order = optics_order(points, eps=1.0, min_points=3)
    assert sorted(i for i, _ in order) == list(range(40))
    assert sum(np.isinf(r) for _, r in order) == 2


def test_dates_of_parts(spark, sf_dir):
    from quillmere.plans import catalog

    row = catalog.QUERIES["date_parts"](spark, sf_dir).orderBy("o_orderkey").first()
    assert isinstance(row.due, datetime.date) and 1 <= row.week <= 53


def test_blocks_of_queries_meet_all_rows(spark):
    from quillmere.operators import features

    rows = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(60)], "v2 long, e2 array<double>")
    queries = rows.where("v2 % 5 = 0").withColumnsRenamed({"v2": "v1", "e2": "e1"})
    whole = sorted(map(tuple, features._distances(rows, queries).collect()))
    assert sorted(map(tuple, features._distances(rows, queries, 5, 16).collect())) == whole
    assert len(whole) == 12 * 59


@pytest.mark.parametrize("values", [[1.5], [2.0, 2.0, None, 7.25], [float(i * i % 113) for i in range(500)], [1e9, *map(float, range(40))]])
def test_quantiles_by_ranges(spark, values):
    from quillmere.operators import analytics

    rows = spark.createDataFrame([(v,) for v in values], "o_totalprice double")
    found = analytics.describe_quantiles(lambda _: rows).first()
    known = [v for v in values if v is not None]
    assert (found.n, found.low, found.high) == (len(known), min(known), max(known))
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99)):
        assert found[name] == pytest.approx(np.quantile(known, q), abs=0.006)


def test_quantiles_of_no_rows(spark):
    from quillmere.operators import analytics

    found = analytics.describe_quantiles(lambda _: spark.createDataFrame([], "o_totalprice double")).collect()
    assert [(r.n, r.median) for r in found] == [(0, None)]


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i % 7, i) for i in range(900)] + [(None, -1)], "k long, v long")
    small = rows.groupBy("k").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    expected = sorted(map(tuple, rows.join(small.drop("n"), "k").collect()))
    for total in (1, 200_000, 10**9):  # all keys are hot, one of them, none
        assert sorted(map(tuple, join_hot(rows, small, "k", "n", total).select("k", "v", "least").collect())) == expected


def test_components_with_hubs(spark):
    pairs = [(5, i) for i in range(300)] + [(9_999, i) for i in range(400, 700)] + [(700 + i, 701 + i) for i in range(30)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(300)}, **{i: 400 for i in [*range(400, 700), 9_999]}, **{i: 700 for i in range(700, 731)}}


def brute_dbscan(ids, points, eps, min_points):
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_points
    cluster = {}
    for first in sorted(ids[core]):
        stack = [] if first in cluster else [int(np.flatnonzero(ids == first)[0])]
        while stack:
            i = stack.pop()
            if int(ids[i]) not in cluster:
                cluster[int(ids[i])] = int(first)
                stack += np.flatnonzero(near[i]).tolist() if core[i] else []
    return {int(i): cluster.get(int(i), -1) for i in ids}


@pytest.mark.parametrize("block", [8192, 60])
def test_dbscan_equals_brute_force(spark, monkeypatch, block):
    from quillmere.operators import models

    draw = np.random.default_rng(1)
    centres = draw.normal(0, 3, (12, 4))
    # clusters over the signs' bounds, chains, noise, copies, and distances of just the radius
    points = np.concatenate([centres[draw.integers(0, 12, 250)] + draw.normal(0, 0.45, (250, 4)), draw.normal(0, 4, (60, 4)), np.tile(draw.normal(9, 0.1, (1, 4)), (40, 1)), np.arange(-6, 6)[:, None] * [0, 0, 0, 1.0] + [20.0, 0, 0, 0]])
    ids = draw.permutation(len(points)) * 3 + 5
    rows = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points, strict=True)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(models, "BLOCK_POINTS", block)
    found = {r.vec_id: r.cluster for r in models.dbscan_clusters(lambda _: rows).collect()}
    assert found == brute_dbscan(ids, points, 1.0, 3)
    assert len(set(found.values())) > 4 and -1 in found.values()


def test_optics_walks_whole_labels(spark):
    from quillmere.operators import models

    draw = np.random.default_rng(2)
    points = draw.normal(0, 3, (4200, 3))  # two labels of 2100; few have three neighbours in any half
    rows = spark.createDataFrame([(i, i % 2, p.tolist()) for i, p in enumerate(points)], "vec_id long, label int, embedding array<double>")
    found = models.optics_clusters(lambda _: rows).collect()
    for label in (0, 1):
        whole = points[label::2]
        gaps = np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1))
        np.fill_diagonal(gaps, np.inf)
        third = np.sort(gaps, axis=1)[:, 2]
        core = np.where(third <= 1.5, third, np.inf)
        mine = sorted((r for r in found if r.label == label), key=lambda r: r.nth)
        order = [r.vec_id // 2 for r in mine]
        assert sorted(order) == list(range(len(whole)))
        reach = np.full(len(whole), np.inf)
        for i, r in zip(order, mine, strict=True):  # each is the nearest that is left, at its distance from those before
            assert np.isclose(r.reachability, reach[i]) if np.isfinite(reach[i]) else np.isinf(r.reachability)
            assert reach[i] <= np.min(reach) + 1e-9
            reach = np.where(gaps[i] <= 1.5, np.minimum(reach, np.maximum(core[i], gaps[i])), reach)
            reach[order[: mine.index(r) + 1]] = np.inf


def test_word2vec_gives_the_vectors_of_all_documents(spark):
    from quillmere.operators import models

    rows = spark.createDataFrame([(1, "cat dog " * 10, "en"), (2, "chat chien " * 10, "fr"), (3, "hund katze " * 10, None), (4, None, "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in models.ml_word2vec_pipeline(lambda _: rows).collect()}
    assert {i: r.n_tokens for i, r in found.items()} == {1: 20, 2: 20, 3: 20, 4: 0}
    assert all(len(r.vector) == 500 and any(r.vector) == (i < 4) for i, r in found.items())


def test_sgd_is_one_model_over_all_rows(spark):
    from quillmere.operators import models

    draw = np.random.default_rng(3)
    x, label = draw.normal(size=(300, 4)), draw.integers(0, 10, 300)
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in draw.permutation(300).tolist()], "vec_id long, label int, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        found = [r.loss for r in models.ml_logreg_sgd(lambda _: rows).orderBy("epoch").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(found, sgd_logistic(x, (label % 2 == 0).astype(float))[1])


def test_tag_predictor_has_the_references_vocabulary(spark, sf_dir, monkeypatch):
    from quillmere.operators import models
    from quillmere.plans import catalog

    class Made(Exception):
        pass

    def made(**options):
        raise Made(f"terms: {options['vocabSize']}")

    monkeypatch.setattr(models, "CountVectorizer", made)
    with pytest.raises(Made, match="terms: 10000"):
        catalog.QUERIES["ml_tag_predictor"](spark, sf_dir)


MARKDOWN = (
    "# Awesome Awesomeness\n\nA curated list of amazingly awesome awesomeness.\n\n- Programming Languages\n\n"
    "\t- [C/C++](https://github.com/fffaraz/awesome-cpp)\n\t- [CMake](https://github.com/onqtam/awesome-cmake)\n\t- Clojure\n"
    "\t\t- [by @mbuczko](https://github.com/mbuczko/awesome-clojure)\n\t\t- [by @razum2um](https://github.com/razum2um/awesome-clojure)\n"
)


@pytest.mark.parametrize(("top", "names"), [(True, ["C/C++", "CMake", "Clojure", "Clojure"]), (False, ["C/C++", "CMake", "by @mbuczko", "by @razum2um"])])
def test_markdown_links(spark, top, names):
    links = ["https://github.com/fffaraz/awesome-cpp", "https://github.com/onqtam/awesome-cmake", "https://github.com/mbuczko/awesome-clojure", "https://github.com/razum2um/awesome-clojure"]
    assert [tuple(p) for p in one(spark, text.markdown_pairs(F.col("text"), top), MARKDOWN)] == list(zip(names, links, strict=True))
    assert one(spark, text.markdown_pairs(F.col("text"), top), "") == [] and one(spark, text.markdown_pairs(F.col("text"), top), None) is None


def test_links_without_text_and_outside_of_lists(spark):
    value = "see [x](http://x) and [](http://y)\n- [z](http://z)\n\n    - [u](http://u)"
    assert [tuple(p) for p in one(spark, text.markdown_pairs(F.col("text"), False), value)] == [("x", "http://x"), ("z", "http://z"), ("u", "http://u")]
    assert [tuple(p) for p in one(spark, text.markdown_pairs(F.col("text"), True), value)] == [("u", "http://u")]


@pytest.mark.parametrize(("short", "part"), [(64, 256), (3, 2), (0, 1)])
def test_pairs_of_short_and_long_sentences_are_alike(spark, monkeypatch, short, part):
    monkeypatch.setattr(text, "SHORT", short)
    monkeypatch.setattr(text, "PART", part)
    values = ["cat dog cat bird fish cow. cow cow", "hen " * 3 + "pig hen owl", "owl", None]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    expected: dict[tuple[str, str], int] = {}
    for value in values:
        for sentence in (value or "").split("."):
            words = sentence.split()
            for i, a in enumerate(words):
                for b in words[i + 1 :]:
                    if a != b:
                        expected[min(a, b), max(a, b)] = expected.get((min(a, b), max(a, b)), 0) + 1
    assert {(r.w1, r.w2): r.n for r in text.word_pairs(docs).collect()} == expected
    assert text.word_pairs_total(lambda name: docs).first()["n"] == sum(expected.values())


def test_missing_ids_of_a_range(spark):
    users = spark.createDataFrame([(2,), (4,), (9,)], "id long")
    assert sorted(r.id for r in warehouse.missing(users, 1, 6).collect()) == [1, 3, 5]


def _state(spark, tmp_path, tags=("a", "b")):
    streaming.set_tags(spark, str(tmp_path / "settings"), tags)
    state = streaming.Summary(spark, str(tmp_path / "summary"), str(tmp_path / "settings"))
    state.begin(spark.createDataFrame([("a", 4), ("c", 1)], "tag string, sentiment int"))
    return state


def test_a_repeated_batch_counts_once_and_settings_hold_for_each_batch(spark, tmp_path):
    state = _state(spark, tmp_path)
    sums = summary.summarise(spark.createDataFrame([("a", 0), ("b", 2), ("c", 2)], "tag string, sentiment int"))
    state.batch(sums, 0)
    state.batch(sums, 0)
    assert {r.tag: r.total for r in state.rows().collect()} == {"a": 2, "b": 1}
    streaming.set_tags(spark, state.settings, ("b", "c"))
    state.batch(sums, 1)
    assert {r.tag: r.total for r in state.rows().collect()} == {"b": 2, "c": 1}


def test_a_stream_recovers_from_its_checkpoint(spark, tmp_path):
    inbox, state = str(tmp_path / "inbox"), _state(spark, tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "tag string, sentiment int").coalesce(1)
    failed = []

    def batch(posts, number):
        state.batch(summary.summarise(posts), number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    def go():
        stream = spark.readStream.schema("tag string, sentiment int").parquet(inbox)
        streaming.run(stream, batch, checkpoint=str(tmp_path / "checkpoint"))

    rows(("a", 1)).write.parquet(inbox)
    go()
    rows(("a", 2), ("b", 3)).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="lost after the write"):
        go()
    go()
    assert failed and {r.tag: r.total for r in state.rows().collect()} == {"a": 3, "b": 1}


def test_endpoints_carry_rows_as_json_and_repeat_batches_safely(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming.Endpoint("posts")
    posts = streaming.Endpoint("posts", str(tmp_path))
    rows = spark.createDataFrame([(1, "é \"x\"", None), (2, None, 0.5)], "id long, text string, lat double")
    posts.publish(rows, 0)
    posts.publish(rows, 0)
    schema = "id long, text string, lat double, batch long"
    found = streaming.to_table(streaming.decoded(posts.read(spark), schema))
    assert sorted(map(tuple, found.collect())) == [(1, "é \"x\"", None, 0), (2, None, 0.5, 0)]


def brute_split(x, y, kind):
    best = None
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            sides = [np.bincount(y[x[:, f] <= cut], minlength=3), np.bincount(y[x[:, f] > cut], minlength=3)]
            value = sum(models.impurity(s, kind) * s.sum() for s in sides) / len(y)
            if best is None or value < best[0] - 1e-12:
                best = (value, f, cut)
    return best


@pytest.mark.parametrize("kind", ["gini", "entropy", "misclass"])
def test_decision_tree_splits_as_brute_force_does(spark, kind):
    draw = np.random.default_rng(5)
    x = draw.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 6) + (x[:, 0] > 3) * (x[:, 2] > 6)).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(300)], "id long, label int, e array<double>")
    found, splits = models.grow_tree(rows, "label", "e", 3, depth=3, kind=kind)
    value, feature, cut = brute_split(x, y, kind)
    sides = [np.bincount(y[m], minlength=3) for m in (x[:, splits[1][0]] <= splits[1][1], x[:, splits[1][0]] > splits[1][1])]
    assert sum(models.impurity(s, kind) * s.sum() for s in sides) / 300 == pytest.approx(value)
    leaves = {}
    for r in found.collect():
        leaves.setdefault(r.node, []).append(r.label)
    if kind != "misclass":
        assert all(len(set(v)) == 1 for v in leaves.values())
    for r in found.limit(40).collect():  # the splits lead each row to its leaf
        node = 1
        while node in splits:
            f, c = splits[node]
            node = 2 * node + int(r.e[f] > c)
        assert node == r.node


def test_tree_of_equal_rows_and_of_a_share_of_features(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 1, [1.0, 2.0])], "id long, label int, e array<double>")
    assert models.grow_tree(rows, "label", "e", 2)[1] == {}
    more = spark.createDataFrame([(i, i % 2, [float(i % 2), 0.0]) for i in range(20)], "id long, label int, e array<double>")
    assert set(models.grow_tree(more, "label", "e", 2, share=0.5, seed=1)[1]) <= {1}


def test_models_learn(spark, sf_dir):
    from quillmere.plans import catalog

    t = lambda name: catalog.QUERIES[name](spark, sf_dir)
    scores = {r.model: r.score for r in t("ml_linear_models").collect()}
    assert set(scores) == {"logistic", "svc", "tree", "dense", "ridge", "lasso", "elastic"}
    losses = [r.loss for r in t("ml_logreg_sgd").orderBy("epoch").collect()]
    assert len(losses) == 5 and losses[-1] < losses[0]
    kmeans = {r.k: r.inertia for r in t("ml_kmeans").collect()}
    assert kmeans[10] < kmeans[3]
    tags = t("ml_tag_predictor").where("lang is not null").collect()
    names = sorted({r.lang for r in tags})
    assert np.mean([names[r.predicted] == r.lang for r in tags]) > 0.8
    prices = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice").collect()}
    stacked = t("ml_stacking").collect()
    middle = np.median(list(prices.values()))
    assert np.mean([(r.price - prices[r.p_partkey]) ** 2 for r in stacked]) <= 1.05 * np.mean([(middle - p) ** 2 for p in prices.values()])
    leaves = t("ml_decision_tree").collect()
    assert sum(r.rows for r in leaves) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_stacking_out_of_fold_predicts_every_row_once(spark, sf_dir):
    rows = models._priced(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    found = models.stacked_rows(rows, "p_partkey", folds=2)
    assert found.count() == rows.count() == found.select("p_partkey").distinct().count()
    assert {"ridge", "tree", "boosted"} <= set(found.columns)


def test_clipped_gradient_stops_where_the_loss_is_clipped():
    wide, y = np.array([[1.0, 30.0]]), np.array([0.0])
    free, clipped = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    models.sgd_steps(free, wide, y)
    models.sgd_steps(clipped, wide, y, clipped=True)
    assert free[1] < 1 and clipped[1] == 1


def test_jobs_by_mode_in_stages_and_side_by_side(spark, sf_dir):
    assert jobs.run_mode(spark, sf_dir, "word_pairs", 3).first()["label"] == "total"
    with pytest.raises(ValueError):
        jobs.run_mode(spark, sf_dir, "word_pairs", 9)
    assert [n for n, _ in jobs.run_staged(spark, sf_dir, "warehouse")] == list(jobs.STAGED["warehouse"])
    assert all(n > 0 for n in jobs.launch(spark, sf_dir, ("dashboard_rows", "edges_top10k")).values())


def test_waiting_items_leave_in_order_and_their_priorities_only_fall():
    draw = np.random.default_rng(3)
    waiting, expected, done = models.Waiting(40), {}, set()
    for _ in range(300):
        items = draw.choice(40, 5, replace=False)
        values = draw.integers(0, 50, 5) / 2
        for i, v in zip(items.tolist(), values.tolist(), strict=True):
            if v < expected.get(i, np.inf):
                expected[i] = v
                done.discard(i)
        waiting.lower(items, values)
        assert len(waiting.heap) <= 2 * 40
        open_ = [(v, i) for i, v in expected.items() if i not in done]
        if draw.random() < 0.5:
            assert waiting.take() == (min(open_)[1] if open_ else None)
            done |= {min(open_)[1]} if open_ else set()


@pytest.mark.parametrize("linear", [False, True])
def test_partial_fit_goes_on_and_repeats_safely(spark, tmp_path, linear):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(60, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) if linear else (x[:, 0] > 0).astype(float)
    rows = [(x[i].tolist(), float(y[i])) for i in range(60)]
    frames = [spark.createDataFrame(part, "embedding array<double>, y double").coalesce(1) for part in (rows[:40], rows[40:], rows[:0])]
    path = str(tmp_path / "weights")
    first = models.partial_fit(frames[0], path, 0, linear)
    assert models.partial_fit(frames[0], path, 0, linear) == first
    both = models.partial_fit(frames[1], path, 1, linear)
    expected = np.zeros(4)
    models.sgd_steps(expected, np.hstack([np.ones((60, 1)), x]), y, linear=linear)
    assert both == pytest.approx(expected.tolist())
    assert models.partial_fit(frames[2], path, 2, linear) == both
    assert models.partial_fit(frames[2], str(tmp_path / "none"), 0, linear) == []


def test_images_are_gray_whole_and_files_that_are_none_are_left_out(spark, tmp_path):
    draw = np.random.default_rng(1)
    pixels = draw.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    (tmp_path / "a.bmp").write_bytes(images.bitmap(pixels))
    (tmp_path / "b.bmp").write_bytes(b"no picture")
    (row,) = images.gray_images(spark, str(tmp_path)).collect()
    assert (row.name, row.height, row.width) == ("a.bmp", 3, 5)
    assert row.gray == pytest.approx((pixels @ np.array([0.299, 0.587, 0.114])).ravel().tolist())


def test_sentiment_of_odd_texts_equals_its_sql(spark):
    import duckdb

    from quillmere.plans import catalog

    rows = [
        (1, None), (2, ""), (3, "..."), (4, "\u00a0good . bad word hate."), (5, "good\u00a0\u00a0\u00a0\u00a0. stupid"), (6, "\u3000!"),
        (7, "\n \n"), (8, "hate hate. good good good"), (10, "good good"), (10, "hate hate hate"), (None, "good"), (12, "abcd good. " + "x. " * 250_000 + "love good z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {tuple(r) for r in text.lexicon_sentiment(lambda _: docs).collect()} == set(duck.sql(catalog.ORACLE_SQL["lexicon_sentiment"]).fetchall())
    few, query = docs.where("coalesce(doc_id, 0) < 12"), catalog.ORACLE_SQL["sentence_split"]
    assert {tuple(r) for r in text.sentence_split(lambda _: few).collect()} == {r for r in duck.sql(query).fetchall() if (r[0] or 0) < 12}


def test_elbow_of_many_values_equals_its_sql(spark):
    import duckdb

    from quillmere.operators import analytics
    from quillmere.plans import catalog

    rows = [(i * 0.01,) for i in range(60_000)] + [(700.0 + i * 0.02,) for i in range(30_000)] + [(1400.0,), (1400.0,), (-1.0,), (None,)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer (c_acctbal DOUBLE)")
    customers = spark.createDataFrame(rows, "c_acctbal double")
    for most in (1e9, 650.0, 599.0, -0.5):
        duck.execute("DELETE FROM customer")
        duck.executemany("INSERT INTO customer SELECT unnest(?)", [[[r[0] for r in rows if r[0] is None or r[0] < most]]])
        found = analytics.elbow_jump(lambda _, most=most: customers.where(f"c_acctbal IS NULL OR c_acctbal < {most}")).collect()
        assert [tuple(r) for r in found] == duck.sql(catalog.ORACLE_SQL["elbow_jump"]).fetchall()


def test_nearest_and_spread_equal_brute_force_with_ties_copies_and_nulls(spark):
    from quillmere.operators import features

    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(size=(150, 8)), np.repeat(draw.normal(size=(1, 8)), 30, 0), 1e4 + draw.normal(0, 1e-3, (20, 8))]).round(3)
    data = [(i, p.tolist()) for i, p in enumerate(points)] + [(200, None), (201, None)]
    rows = spark.createDataFrame(data, "v2 long, e2 array<double>")
    queries = rows.where("v2 % 3 = 0").withColumnsRenamed({"v2": "v1", "e2": "e1"})

    def gaps(a, skip):
        known = [None if a is None or b is None else float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for _, b in data]
        return [(v, d) for (v, _), d in zip(data, known, strict=True) if v != skip]

    def place(pair):
        return (np.inf if pair[1] is None else np.floor(pair[1] * 1e6 + 0.5), pair[0])

    want = {v: sorted(gaps(a, v), key=place)[:4] for v, a in data if v % 3 == 0}
    for sizes in ((1000, 1000), (11, 40)):
        found = {}
        for r in features.nearest(rows, queries, 4, *sizes).orderBy("v1", "r").collect():
            found.setdefault(r.v1, []).append((r.v2, r.d))
        assert {k: [v for v, _ in x] for k, x in found.items()} == {k: [v for v, _ in x] for k, x in want.items()}
        assert all(d is None and e is None or abs(d - e) < 1e-9 for k in found for (_, d), (_, e) in zip(found[k], want[k], strict=True))
        for r in features.spread_of(rows, queries, *sizes).collect():
            all_ = gaps(dict(data)[r.v1], r.v1)
            d = [x for _, x in all_ if x is not None]
            assert r.n == len(all_) and (r.nearest is None if not d else abs(r.nearest - min(d)) < 1e-4 and abs(r.farthest - max(d)) < 1e-4 and abs(r["mean"] - np.mean(d)) < 1e-4)


def test_only_the_nearest_of_a_slice_are_shuffled(spark):
    from quillmere.operators import features

    rows = spark.createDataFrame([(i, [float(i * i % 101), float(i)]) for i in range(400)], "v2 long, e2 array<double>")
    queries = rows.where("v2 % 100 = 0").withColumnsRenamed({"v2": "v1", "e2": "e1"})
    met = features.meet(rows, queries, features._nearest(3), "v1 long, v2 long, key double, d double", 4, 100)
    assert met.count() <= 4 * 3 * 4  # queries, nearest, slices


@pytest.mark.parametrize(("first", "most"), [(4, 1000), (100, 1000), (4, 2)])
def test_top_pairs_are_those_of_all_pairs_but_few_words_meet(spark, monkeypatch, first, most):
    draw = np.random.default_rng(5)
    names = ["w" + "".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(300)]
    made = [". ".join(" ".join(names[min(299, int(i))] for i in draw.zipf(1.3, 12) - 1) for _ in range(4)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(made), (900, None), (901, " ".join(names[:90])), (902, f"{names[7]} " * 30 + names[9])], "doc_id long, text string")
    monkeypatch.setattr(text, "FIRST_WORDS", first)
    monkeypatch.setattr(text, "MOST_WORDS", most)
    lists, pairs = [], text.pairs_among
    monkeypatch.setattr(text, "pairs_among", lambda bags, among: lists.append(among) or pairs(bags, among))
    found = list(map(tuple, text.top_pairs(docs, 5).collect()))
    assert found == sorted(map(tuple, text.word_pairs(docs).collect()), key=lambda r: (-r[2], r[0], r[1]))[:5]
    assert (lists[-1] is None) == (most == 2) and (most == 2 or len(lists[-1]) < 100)


@pytest.mark.parametrize("repeated", [False, True])
def test_terms_of_documents_equal_sql_and_need_no_shuffle_by_document(spark, repeated):
    import duckdb

    from quillmere.plans import catalog

    rows = [(i % 30 if repeated else i, "en" if i % 3 else None, " ".join(f"w{chr(97 + j % 11)}" * (1 + j % 2) for j in range(i % 17))) for i in range(60)] + [(99, "de", None), (98, "de", "...")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    for name in ("tfidf_top_terms", "bow_idf"):
        assert sorted(map(repr, map(tuple, getattr(text, name)(lambda _: docs).collect()))) == sorted(map(repr, duck.sql(catalog.ORACLE_SQL[name]).fetchall()))
    plan = text.document_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(doc_id" in plan) == repeated


@pytest.mark.parametrize("sizes", [(1000, 1000), (7, 130)])
def test_recommendations_are_the_highest_scores_and_ties_go_by_id(spark, monkeypatch, sizes):
    monkeypatch.setattr(models, "GROUP_ITEMS", 10)
    draw = np.random.default_rng(2)
    users, items = (draw.normal(size=(n, 3)).round(2).astype(np.float32) for n in (20, 300))
    items[40:60] = items[40]
    rows = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<float>") for x in (users, items)]
    found = {(r.user_id, r.r): r.movie_id for r in models.recommend(*rows, 5, *sizes).collect()}
    scores = users.astype(float) @ items.astype(float).T
    want = {(u, r): sorted(range(300), key=lambda i: (-round(scores[u, i], 9), i))[r] for u in range(20) for r in range(5)}
    assert found == want
