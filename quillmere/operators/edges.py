"""Edge lists by month: top pairs of one joined with another, in two ways that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.plans.registry import query

TOP = 10_000
FIRST, SECOND = 1998, 1997
#: Top pairs are TOP rows at the most, which is why they may be broadcast.
_MONTH_SQL = "SELECT l_suppkey AS prev, l_partkey AS curr, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY l_suppkey, l_partkey"
_TOP_SQL = f"SELECT DISTINCT prev, curr, n FROM ({_MONTH_SQL.format(year=FIRST)}) m ORDER BY n DESC, prev, curr LIMIT {TOP}"
_JOIN_SQL = f"SELECT m2.prev, m2.curr, m2.n FROM ({_MONTH_SQL.format(year=SECOND)}) m2 JOIN ({_TOP_SQL}) t ON t.prev = m2.prev AND t.curr = m2.curr"


def month(lineitem: DataFrame, year: int) -> DataFrame:
    """(prev, curr, n) of one period; the period is a range of dates, which the scan can skip by."""
    ship = F.col("l_shipdate")
    rows = lineitem.where((ship >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (ship < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return rows.groupBy(F.col("l_suppkey").alias("prev"), F.col("l_partkey").alias("curr")).agg(F.sum("l_quantity").cast("long").alias("n"))


def top_pairs(edges: DataFrame, k: int = TOP) -> DataFrame:
    """The k largest distinct (n, pair), ties in order of the pair: no total sort, k rows a task."""
    return edges.select("prev", "curr", "n").distinct().orderBy(F.desc("n"), "prev", "curr").limit(k)


def broadcast_join(top: DataFrame, other: DataFrame) -> DataFrame:
    return other.join(F.broadcast(top.select("prev", "curr")), ["prev", "curr"], "left_semi")


def shuffle_join(top: DataFrame, other: DataFrame) -> DataFrame:
    return other.join(top.select("prev", "curr").hint("merge"), ["prev", "curr"])


@query("O2", _TOP_SQL)
def edges_top10k(t) -> DataFrame:
    return top_pairs(month(t("lineitem"), FIRST))


@query("J1 S6", _JOIN_SQL)
def edges_broadcast_join(t) -> DataFrame:
    return broadcast_join(top_pairs(month(t("lineitem"), FIRST)), month(t("lineitem"), SECOND))


@query("J2 S5", _JOIN_SQL)
def edges_shuffle_join(t) -> DataFrame:
    return shuffle_join(top_pairs(month(t("lineitem"), FIRST)), month(t("lineitem"), SECOND))


@query("J3", "SELECT CAST(0 AS BIGINT) AS differences")
def edges_join_equivalence(t) -> DataFrame:
    """How many rows the two joins don't have in common: none."""
    one, two = edges_broadcast_join(t), edges_shuffle_join(t)
    differences = one.exceptAll(two).unionAll(two.exceptAll(one))
    return differences.agg(F.count(F.lit(1)).alias("differences"))
