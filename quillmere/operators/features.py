"""Feature engineering and evaluation as closed formulas over columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.plans.registry import query
from quillmere.shipping import ship

#: The held-out share of a split is one part in this many.
PARTS = 5


def r4(column: Column) -> Column:
    return F.round(column, 4)


@query("A19", "SELECT c_nationkey, CAST(count(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 END) AS BIGINT) AS automobile, CAST(count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS BIGINT) AS building, CAST(count(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END) AS BIGINT) AS machinery FROM customer GROUP BY c_nationkey")
def pivot_counts(t) -> DataFrame:
    """The pivoted values are named, which spares a pass to find them."""
    kinds = ("AUTOMOBILE", "BUILDING", "MACHINERY")
    wide = t("customer").groupBy("c_nationkey").pivot("c_mktsegment", list(kinds)).agg(F.count("c_custkey"))
    return wide.select("c_nationkey", *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k.lower()) for k in kinds))


_SIZES = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size END"


@query("E10", f"""SELECT p_partkey, CAST(coalesce(size, 0) AS DOUBLE) AS as_written_zero, round(coalesce(size, avg(size) OVER (PARTITION BY p_type, p_brand), avg(size) OVER ()), 4) AS as_written, round(coalesce(nullif(size, 0), avg(nullif(size, 0)) OVER (PARTITION BY p_type, p_brand), avg(nullif(size, 0)) OVER ()), 4) AS as_intended
FROM (SELECT *, {_SIZES} AS size FROM part) p""")
def mean_by_category_impute(t) -> DataFrame:
    """Missing values take their category's mean, or that of all. Zeros count as values as written,
    and as missing as intended."""
    rows = t("part").withColumn("size", F.expr(_SIZES)).withColumn("filled", F.nullif("size", F.lit(0)))
    means = rows.groupBy("p_type", "p_brand").agg(F.avg("size").alias("m1"), F.avg("filled").alias("m2"))
    overall = F.broadcast(rows.agg(F.avg("size").alias("o1"), F.avg("filled").alias("o2")))  # one row
    joined = rows.join(means, ["p_type", "p_brand"]).join(overall)
    return joined.select(
        "p_partkey", F.coalesce("size", F.lit(0)).cast("double").alias("as_written_zero"), r4(F.coalesce("size", "m1", "o1")).alias("as_written"), r4(F.coalesce("filled", "m2", "o2")).alias("as_intended")
    )


@query("G13", "SELECT round(corr(p_retailprice, p_size), 4) AS price_size, round(corr(p_retailprice, p_partkey), 4) AS price_key FROM part")
def corr_fare_class(t) -> DataFrame:
    return t("part").agg(r4(F.corr("p_retailprice", F.col("p_size").cast("double"))).alias("price_size"), r4(F.corr("p_retailprice", F.col("p_partkey").cast("double"))).alias("price_key"))


@query("E8 J11", "SELECT p_partkey, CAST(i AS BIGINT) AS type_index, 1.0::DOUBLE AS value FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part) d) x USING (p_type)")
def onehot_long(t) -> DataFrame:
    """Labels by alphabetical index, one-hot in long form. Only the dictionary of labels is put in order."""
    kinds = t("part").select("p_type").distinct()
    indexed = kinds.select("p_type", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("long").alias("type_index"))
    return t("part").join(indexed, "p_type").select("p_partkey", "type_index", F.lit(1.0).alias("value"))


@query("E9 E11 E12 E13", f"""SELECT p_partkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS scaled_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 4) AS scaled_price, round(x + p_retailprice, 4) AS total FROM
(SELECT p_partkey, p_retailprice, CAST(coalesce(size, (SELECT size FROM (SELECT {_SIZES} AS size FROM part) m WHERE size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1)) AS DOUBLE) AS x FROM (SELECT *, {_SIZES} AS size FROM part) s) p""")
def impute_scale_sum(t) -> DataFrame:
    """The mode for missing values, then population z-scores, and a sum of columns."""
    rows = t("part").withColumn("size", F.expr(_SIZES))
    mode = F.broadcast(rows.where("size IS NOT NULL").agg(F.mode("size", True).alias("mode")))  # one row
    filled = rows.join(mode).withColumn("x", F.coalesce("size", "mode").cast("double"))
    stats = F.broadcast(filled.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for c in ("x", "p_retailprice"))))  # one row
    z = lambda c: r4((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"))
    return filled.join(stats).select("p_partkey", z("x").alias("scaled_size"), z("p_retailprice").alias("scaled_price"), r4(F.col("x") + F.col("p_retailprice")).alias("total"))


@query("A28 X7", "SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 4) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e GROUP BY label, pos")
def vector_mean_by_group(t) -> DataFrame:
    rows = t("embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(r4(F.avg(F.col("v").cast("double"))).alias("mean"))


_NORMED = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"


@query("X8 X9 E20 E21", f"SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm, round(0.299 * e[1] + 0.587 * e[2] + 0.114 * e[3], 4) AS gray, round(list_sum(e[1:32]) / 32, 4) AS half_mean FROM ({_NORMED}) n")
def normalise_vectors(t) -> DataFrame:
    """Norm, a weighted sum of three channels, and the mean under a mask of the first half."""
    v = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    gray = 0.299 * F.col("e")[0] + 0.587 * F.col("e")[1] + 0.114 * F.col("e")[2]
    masked = F.transform("e", lambda x, i: F.when(i < 32, x).otherwise(0.0))
    return v.select("vec_id", r4(F.sqrt(total(F.transform("e", lambda x: x * x)))).alias("norm"), r4(gray).alias("gray"), r4(total(masked) / 32).alias("half_mean"))


#: Queries of a block, and rows of a slice: each block meets each slice in a task. Queries of a step, whose distances to a slice are held at once.
BLOCK_QUERIES, SLICE_ROWS, STEP_QUERIES = 4_096, 20_000, 128
#: Stands for the squared distance to a vector that is not known: behind all others.
UNKNOWN = 1e300


def _matrix(values: pd.Series) -> np.ndarray:
    """Vectors as rows; what a vector lacks, or all of one that is null, is NaN."""
    width = max((len(v) for v in values if v is not None), default=0)
    if all(v is not None and len(v) == width for v in values):
        return np.stack(values).astype("<f8")
    out = np.full((len(values), width), np.nan)
    for row, v in zip(out, values, strict=True):
        row[: 0 if v is None else len(v)] = np.nan if v is None else v
    return out


def _apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a from rows j of b, squares summed in order of position."""
    total = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x[i] - y[j]) ** 2
    return np.sqrt(total)


def _steps(ids: np.ndarray, points: np.ndarray, other_ids: np.ndarray, others: np.ndarray):
    """(from where, gaps, own pairs) of STEP_QUERIES queries at a time.

    gaps are the squared distances to all of the slice by one product, which is off by rounding
    and NaN where a distance is not known; own pairs (i, j) have equal ids.
    """
    wide = np.hstack([others, (others * others).sum(1)[:, None]]).T.copy()
    order = np.argsort(other_ids, kind="stable")
    lows, highs = (np.searchsorted(other_ids[order], ids, side) for side in ("left", "right"))
    for at in range(0, len(ids), STEP_QUERIES):
        step = points[at : at + STEP_QUERIES]
        gaps = np.hstack([-2 * step, np.ones((len(step), 1))]) @ wide
        gaps += (step * step).sum(1)[:, None]
        own = [(i, j) for i in range(len(step)) for j in order[lows[at + i] : highs[at + i]]]
        yield at, gaps, (np.array([i for i, _ in own], int), np.array([j for _, j in own], int))


def _all_pairs(ids, points, other_ids, others) -> pd.DataFrame:
    i, j = (x.ravel() for x in np.indices((len(ids), len(other_ids))))
    d = _apart(points, others, i, j)
    out = pd.DataFrame({"v1": ids[i], "v2": other_ids[j], "d": d})
    return out[out["v1"] != out["v2"]]


def _nearest(k: int) -> Callable:
    """The k nearest of a slice to each query, by distance in millionths, then id."""

    def run(ids, points, other_ids, others) -> pd.DataFrame:
        found = []
        squares = (others * others).sum(1)
        most = np.nanmax(squares) if np.isfinite(squares).any() else 0.0
        for at, gaps, own in _steps(ids, points, other_ids, others):
            gaps[np.isnan(gaps)] = UNKNOWN
            gaps[own] = np.inf
            # the k-th least of the least gaps of k groups or more bounds the k-th least of all
            starts = np.unique(np.linspace(0, gaps.shape[1], min(gaps.shape[1], 32 * k), endpoint=False, dtype=int))
            least = np.minimum.reduceat(gaps, starts, axis=1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(gaps), np.inf)
            own_squares = np.nan_to_num((points[at : at + STEP_QUERIES] ** 2).sum(1))
            # what rounds to the same millionth, and what the product may be off by
            bound = np.where(bound < UNKNOWN, (np.sqrt(np.maximum(bound, 0)) + 2e-6) ** 2 + 1e-9 * (1 + own_squares + most), bound)
            i, j = np.nonzero((gaps <= bound[:, None]) & (gaps < np.inf))
            d = _apart(points[at : at + STEP_QUERIES], others, i, j)
            key = np.where(np.isnan(d), np.inf, np.floor(d * 1e6 + 0.5))
            order = np.lexsort((other_ids[j], key, i))
            i, j, d, key = i[order], j[order], d[order], key[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append(pd.DataFrame({"v1": ids[at + i[kept]], "v2": other_ids[j[kept]], "key": key[kept], "d": d[kept]}))
        return pd.concat(found)

    return run


def _spread(ids, points, other_ids, others) -> pd.DataFrame:
    """Of each query and a slice: how many others, how many known distances, the least, the greatest, their sum."""
    found = []
    squares = (others * others).sum(1)
    for at, gaps, own in _steps(ids, points, other_ids, others):
        step = points[at : at + STEP_QUERIES]
        n = gaps.shape[1] - np.bincount(own[0], minlength=len(step))
        i, j = np.nonzero(gaps <= 1e-4 * ((step * step).sum(1)[:, None] + squares))  # the product can't tell small ones
        d = np.sqrt(np.maximum(gaps, 0, out=gaps), out=gaps)
        d[i, j] = _apart(step, others, i, j)
        d[own] = np.nan
        known = ~np.isnan(d)
        some = known.any(1)
        ends = []
        for pick, none in ((np.argmin, np.inf), (np.argmax, -np.inf)):
            end = np.where(some, _apart(step, others, np.arange(len(step)), pick(np.where(known, d, none), axis=1)), np.nan)
            ends.append(end)
        found.append(pd.DataFrame({"v1": ids[at : at + len(step)], "n": n, "known": known.sum(1), "nearest": ends[0], "farthest": ends[1], "total": np.nansum(d, axis=1)}))
    return pd.concat(found)


def meet(rows: DataFrame, queries: DataFrame, function: Callable, schema: str, block_queries: int, slice_rows: int) -> DataFrame:
    """function(ids, points of a block of queries, ids, points of a slice of rows) for each block and slice."""
    ship(rows.sparkSession)
    rows, queries = rows.where("v2 IS NOT NULL"), queries.where("v1 IS NOT NULL")
    blocks, slices = (max(1, -(-r.count() // n)) for r, n in ((queries, block_queries), (rows, slice_rows)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(pdf["e"])
        return pd.DataFrame([(pdf["part"].iloc[0], points.shape[1], pdf["v"].to_numpy("<i8").tobytes(), points.tobytes())], columns=["part", "width", "ids", "points"])

    def packed(side: DataFrame, n: str, parts: int) -> DataFrame:
        # rows with one id are one vector mostly, so vectors take part in the hash
        dealt = side.select(F.col(f"v{n}").cast("long").alias("v"), F.col(f"e{n}").alias("e"), F.pmod(F.xxhash64(f"v{n}", f"e{n}"), F.lit(parts)).cast("int").alias("part"))
        return dealt.groupBy("part").applyInPandas(pack, "part int, width int, ids binary, points binary")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:  # one side got no rows
            return pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])
        width, sides = int(pdf["width"].max()), []
        for row in pdf.sort_values("of_rows").itertuples():
            ids = np.frombuffer(row.ids, "<i8")
            points = np.frombuffer(row.points, "<f8").reshape(len(ids), row.width)
            sides += [ids, np.pad(points, ((0, 0), (0, width - row.width)), constant_values=np.nan)]
        return function(*sides)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed(queries, "1", blocks).select(F.col("part").alias("block"), each(slices).alias("slice"), F.lit(False).alias("of_rows"), "width", "ids", "points")
    right = packed(rows, "2", slices).select(each(blocks).alias("block"), F.col("part").alias("slice"), F.lit(True).alias("of_rows"), "width", "ids", "points")
    return left.unionByName(right).groupBy("block", "slice").applyInPandas(run, schema)


def _distances(rows: DataFrame, queries: DataFrame, block_queries: int = BLOCK_QUERIES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(v1, v2, d) of every query and every other row."""
    return meet(rows, queries, _all_pairs, "v1 long, v2 long, d double", block_queries, slice_rows)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(v1, v2, d, r) of the k nearest other rows of each query.

    All distances are taken, by products of a block and a slice; those that can be among the nearest
    are taken again as differences, and only the k nearest of each slice are shuffled.
    """
    found = meet(rows, queries, _nearest(k), "v1 long, v2 long, key double, d double", block_queries, slice_rows)
    nth = F.row_number().over(Window.partitionBy("v1").orderBy("key", "v2"))
    return found.withColumn("r", nth).where(F.col("r") <= k).select("v1", "v2", F.nanvl("d", F.lit(None).cast("double")).alias("d"), "r")


def spread_of(rows: DataFrame, queries: DataFrame, block_queries: int = BLOCK_QUERIES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(v1, n, nearest, farthest, mean) over the distances of each query to all other rows."""
    found = meet(rows, queries, _spread, "v1 long, n long, known long, nearest double, farthest double, total double", block_queries, slice_rows).where("n > 0")
    known = lambda c: F.when(F.col("known") > 0, F.col(c))
    mean = F.sum("total") / F.nullif(F.sum("known"), F.lit(0))
    return found.groupBy("v1").agg(F.sum("n").alias("n"), r4(F.min(known("nearest"))).alias("nearest"), r4(F.max(known("farthest"))).alias("farthest"), r4(mean).alias("mean"))


def _queries(t) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    wide = lambda n: t("embeddings").select(F.col("vec_id").alias(f"v{n}"), F.transform("embedding", lambda x: x.cast("double")).alias(f"e{n}"))
    return wide(2), wide(1).where("v1 % 100 = 0")


_DIST_SQL = f"SELECT a.vec_id AS v1, b.vec_id AS v2, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM ({_NORMED}) a, ({_NORMED}) b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


@query("J15", f"SELECT v1, CAST(count(*) AS BIGINT) AS n, round(min(d), 4) AS nearest, round(max(d), 4) AS farthest, round(avg(d), 4) AS mean FROM ({_DIST_SQL}) x GROUP BY v1")
def pairwise_distance(t) -> DataFrame:
    return spread_of(*_queries(t))


@query("J16 G11", f"SELECT v1, CAST(r AS INTEGER) AS r, v2, round(d, 4) AS d FROM (SELECT v1, v2, d, row_number() OVER (PARTITION BY v1 ORDER BY round(d, 6), v2) AS r FROM ({_DIST_SQL}) x) y WHERE r <= 5")
def knn_neighbours(t) -> DataFrame:
    """The five nearest of each query."""
    return nearest(*_queries(t), 5).select("v1", "r", "v2", r4(F.col("d")).alias("d"))


#: The grid of neighbours that vote.
VOTERS = (1, 3, 5, 9)
_VOTES_SQL = f"SELECT v1, q.label AS truth, n.label AS vote, row_number() OVER (PARTITION BY v1 ORDER BY round(d, 6), v2) AS r FROM ({_DIST_SQL}) x JOIN embeddings q ON q.vec_id = v1 JOIN embeddings n ON n.vec_id = v2"
_VOTED_SQL = f"SELECT k, v1, truth, vote, count(*) AS c FROM ({_VOTES_SQL}) v JOIN (SELECT unnest([1, 3, 5, 9]) AS k) g ON r <= k GROUP BY k, v1, truth, vote"


@query("M7 G3", f"""SELECT CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN vote = truth THEN 1.0 ELSE 0.0 END), 4) AS accuracy
FROM (SELECT k, v1, truth, vote, row_number() OVER (PARTITION BY k, v1 ORDER BY c DESC, vote) AS r FROM ({_VOTED_SQL}) c) w WHERE r = 1 GROUP BY k""")
def knn_classifier(t) -> DataFrame:
    """How often the nearest k others vote for a query's own class, for each k of the grid; the least class wins ties."""
    met = nearest(*_queries(t), max(VOTERS)).select("v1", "v2", "r")
    labels = t("embeddings").select(F.col("vec_id").alias("v2"), F.col("label").alias("vote"))
    voted = met.join(labels, "v2").join(labels.select(F.col("v2").alias("v1"), F.col("vote").alias("truth")), "v1")
    grid = F.explode(F.filter(F.array(*map(F.lit, VOTERS)), lambda k: F.col("r") <= k)).alias("k")
    counts = voted.select("v1", "truth", "vote", "r").select("v1", "truth", "vote", grid).groupBy("k", "v1", "truth", "vote").agg(F.count(F.lit(1)).alias("c"))
    winner = counts.groupBy("k", "v1", "truth").agg(F.max_by("vote", F.struct("c", -F.col("vote"))).alias("vote"))
    return winner.groupBy("k").agg(F.count(F.lit(1)).alias("n"), r4(F.avg((F.col("vote") == F.col("truth")).cast("double"))).alias("accuracy"))


_TABLE = "SELECT label AS a, CAST(CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS INTEGER) AS b FROM embeddings"


def _labelled(t) -> DataFrame:
    e = F.col("embedding")
    return t("embeddings").select(F.col("label").alias("a"), ((e[0] > 0).cast("int") + 2 * (e[1] > 0).cast("int")).alias("b"))


@query("G9", f"""SELECT round((nij - ni * nj / n) / ((ni + nj) / 2 - ni * nj / n), 4) AS rand_index FROM (SELECT (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM ({_TABLE}) t GROUP BY a, b) x) AS nij, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM ({_TABLE}) t GROUP BY a) x) AS ni,
(SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM ({_TABLE}) t GROUP BY b) x) AS nj, (SELECT count(*) * (count(*) - 1) / 2.0 FROM ({_TABLE}) t) AS n) s""")
def adjusted_rand(t) -> DataFrame:
    """From the contingency table, whose margins are sums of its cells."""
    cells = _labelled(t).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    parts = [cells.agg(pairs("c").alias("nij"), F.sum("c").alias("m"))]
    parts += [cells.groupBy(k).agg(F.sum("c").alias("c")).agg(pairs("c").alias(n)) for k, n in (("a", "ni"), ("b", "nj"))]
    one = parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each
    expected = F.col("ni") * F.col("nj") / (F.col("m") * (F.col("m") - 1) / 2)
    return one.select(r4((F.col("nij") - expected) / ((F.col("ni") + F.col("nj")) / 2 - expected)).alias("rand_index"))


@query("A30", f"SELECT a, CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS p0, CAST(sum(CASE WHEN b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p1, CAST(sum(CASE WHEN b = 2 THEN 1 ELSE 0 END) AS BIGINT) AS p2, CAST(sum(CASE WHEN b = 3 THEN 1 ELSE 0 END) AS BIGINT) AS p3 FROM ({_TABLE}) t GROUP BY a")
def confusion_matrix(t) -> DataFrame:
    wide = _labelled(t).groupBy("a").pivot("b", [0, 1, 2, 3]).count()
    return wide.select("a", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"p{i}") for i in range(4)))


@query("G17", "SELECT label AS cluster, CAST(count(*) AS BIGINT) AS size FROM embeddings GROUP BY label")
def cluster_sizes(t) -> DataFrame:
    return t("embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


# A fixed score stands in for a model's: the sigmoid of a vector's first two entries.
_SCORED = "SELECT vec_id, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-(3 * CAST(embedding[1] AS DOUBLE) - 2 * CAST(embedding[2] AS DOUBLE)))) AS p FROM embeddings"


def _scored(t) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return t("embeddings").select("vec_id", F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("y"), (1 / (1 + F.exp(-(3 * e(0) - 2 * e(1))))).alias("p"))


@query("G16", f"SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 4) AS loss, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))) + 0.01 * (3 + 2) + 0.01 * (9 + 4), 4) AS penalised FROM (SELECT y, greatest(1e-5, least(1 - 1e-5, p)) AS q FROM ({_SCORED}) s) c")
def log_loss(t) -> DataFrame:
    q = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), F.col("p")))
    loss = F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q)))
    return _scored(t).agg(r4(loss).alias("loss"), r4(loss + 0.01 * (3 + 2) + 0.01 * (9 + 4)).alias("penalised"))


@query("G4 G7 G15 V9", f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(power(y - p, 2)), 4) AS mse, CAST(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ({_SCORED}) s")
def classification_metrics(t) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    right = ((p >= 0.5) == (y == 1)).cast("double")
    return _scored(t).agg(F.count(F.lit(1)).alias("n"), r4(F.avg(right)).alias("accuracy"), r4(F.avg(F.pow(y - p, 2))).alias("mse"), F.sum(((p >= 0.5) & (y == 1)).cast("long")).alias("hits"))


@query("G8 O7", f"""SELECT round((SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM ({_SCORED}) a, ({_SCORED}) b WHERE a.y = 1 AND b.y = 0), 4) AS auc, round((SELECT avg(y) FROM (SELECT y FROM ({_SCORED}) s ORDER BY p DESC, vec_id LIMIT 10) k), 4) AS precision_at_10,
round((SELECT sum(y) FROM (SELECT y FROM ({_SCORED}) s ORDER BY p DESC, vec_id LIMIT 10) k) / (SELECT sum(y) FROM ({_SCORED}) s), 4) AS recall_at_10""")
def ranking_metrics(t) -> DataFrame:
    """The area under the curve by ranks within and before ranges of scores: no pair is made."""
    rows = _scored(t).withColumn("bin", F.floor(F.col("p") * 1000))
    tied = rows.groupBy("bin", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    within = Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = tied.withColumn("lower", F.coalesce(F.sum("neg").over(within), F.lit(0.0)))
    bins = tied.groupBy("bin").agg(F.sum("neg").alias("n"))  # at most 1001 rows
    offsets = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    wins = inside.join(F.broadcast(offsets), "bin").agg((F.sum(F.col("pos") * (F.col("lower") + F.col("before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("all"))
    top = rows.orderBy(F.desc("p"), "vec_id").limit(10).agg(F.avg("y").alias("precision"), F.sum("y").alias("hits"))
    return wins.join(F.broadcast(top)).select(r4(F.col("auc")).alias("auc"), r4(F.col("precision")).alias("precision_at_10"), r4(F.col("hits") / F.col("all")).alias("recall_at_10"))


@query("X2", "SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 4) AS sigmoid, round(greatest(-0.1, least(0.1, CAST(embedding[1] AS DOUBLE))), 4) AS clipped FROM embeddings")
def sigmoid_clip(t) -> DataFrame:
    x = F.col("embedding")[0].cast("double")
    return t("embeddings").select("vec_id", r4(1 / (1 + F.exp(-x))).alias("sigmoid"), r4(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), x))).alias("clipped"))


@query("X10", "SELECT label, round(0.05 * ln(0.05 / q) + 0.95 * ln(0.95 / (1 - q)), 4) AS kl FROM (SELECT label, greatest(0.01, least(0.99, avg(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE)))))) AS q FROM embeddings GROUP BY label) a")
def kl_divergence(t) -> DataFrame:
    """How far a unit's mean activation is from the wanted sparsity."""
    mean = F.avg(1 / (1 + F.exp(-F.col("embedding")[0].cast("double"))))
    q = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("q")))
    kl = 0.05 * F.ln(0.05 / q) + 0.95 * F.ln(0.95 / (1 - q))
    return t("embeddings").groupBy("label").agg(mean.alias("q")).select("label", r4(kl).alias("kl"))


@query("G1 G2", f"SELECT CASE WHEN c_custkey % {PARTS} = 0 THEN 'test' ELSE 'train' END AS part, CAST(count(*) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def hash_split(t) -> DataFrame:
    """A split by the key, which every engine and every run makes alike."""
    part = F.when(F.col("c_custkey") % PARTS == 0, "test").otherwise("train").alias("part")
    return t("customer").groupBy(part).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("c_acctbal")).alias("mean"))


_STACKED_SQL = "SELECT 'train' AS part, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'test', s_suppkey, s_nationkey, s_acctbal FROM supplier"


@query("U7", f"""SELECT part, id, CAST(seen AS BIGINT) AS seen, round(balance - mean, 4) AS centred FROM (SELECT * FROM ({_STACKED_SQL}) s JOIN
(SELECT nation, count(*) AS seen, avg(balance) AS mean FROM ({_STACKED_SQL}) s GROUP BY nation) n USING (nation)) x WHERE part = 'test'""")
def stacked_split(t) -> DataFrame:
    """Train and test rows stacked, features made over both, and the test rows cut off again.

    Rows of a table have no position; a flag of the source tells the parts.
    """
    stacked = t("customer").select(F.lit("train").alias("part"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    stacked = stacked.unionByName(t("supplier").select(F.lit("test").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))
    seen = stacked.groupBy("nation").agg(F.count(F.lit(1)).alias("seen"), F.avg("balance").alias("mean"))
    return stacked.where("part = 'test'").join(seen, "nation").select("part", "id", "seen", r4(F.col("balance") - F.col("mean")).alias("centred"))


@query("A29", """SELECT threshold, round(gini, 4) AS gini FROM (SELECT v AS threshold, ((n * (1 - power(p / n, 2) - power(1 - p / n, 2))) + CASE WHEN total - n > 0 THEN (total - n) * (1 - power((pos - p) / (total - n), 2) - power(1 - (pos - p) / (total - n), 2)) ELSE 0 END) / total AS gini FROM
(SELECT v, CAST(sum(c) OVER (ORDER BY v) AS DOUBLE) AS n, CAST(sum(s) OVER (ORDER BY v) AS DOUBLE) AS p, CAST(sum(c) OVER () AS DOUBLE) AS total, CAST(sum(s) OVER () AS DOUBLE) AS pos FROM (SELECT p_size AS v, count(*) AS c, sum(CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS s FROM part GROUP BY p_size) g) w) x ORDER BY round(gini, 9), threshold LIMIT 1""")
def split_search_gini(t) -> DataFrame:
    """The best split of one feature: class counts up to each value, then the least impurity.

    Rows are counted by value first; the running sums are over distinct values of a small domain.
    """
    counts = t("part").groupBy(F.col("p_size").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("p_retailprice") > 1000).cast("long")).alias("s"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = counts.select("v", *(F.sum(c).over(w).cast("double").alias(n) for c, w, n in (("c", upto, "n"), ("s", upto, "p"), ("c", whole, "total"), ("s", whole, "pos"))))
    impurity = lambda p, n: n * (1 - F.pow(p / n, 2) - F.pow(1 - p / n, 2))
    rest = F.col("total") - F.col("n")
    gini = (impurity(F.col("p"), F.col("n")) + F.when(rest > 0, impurity(F.col("pos") - F.col("p"), F.nullif(rest, F.lit(0.0)))).otherwise(0.0)) / F.col("total")
    return sums.select(F.col("v").alias("threshold"), gini.alias("g")).orderBy(F.round("g", 9), "threshold").limit(1).select("threshold", r4(F.col("g")).alias("gini"))
