"""Per-tag sentiment summary: a commutative monoid over scored posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.plans.registry import query

#: The watched tags (role: the settings table).
WATCHED = ("click", "purchase", "view")


def score_of(value: Column) -> Column:
    """A sentiment from 0 to 4."""
    return F.least(F.lit(4), F.greatest(F.lit(0), F.floor(value / 20))).cast("int")


def scored_posts(events: DataFrame) -> DataFrame:
    """(tag, sentiment) of each event."""
    return events.select(F.col("event_type").alias("tag"), score_of(F.col("value")).alias("sentiment"))


def summarise(posts: DataFrame) -> DataFrame:
    """Counts of each polarity, their total, the cumulative score and its mean, by tag.

    Every column but the mean is a sum, so partial results merge in any order.
    """
    score = F.col("sentiment")
    return with_mean(
        posts.groupBy("tag").agg(
            F.sum((score > 2).cast("long")).alias("positive"),
            F.sum((score == 2).cast("long")).alias("neutral"),
            F.sum((score < 2).cast("long")).alias("negative"),
            F.count(F.lit(1)).alias("total"),
            F.sum(score.cast("long")).alias("cumulative"),
        )
    )


COUNTS = ("positive", "neutral", "negative", "total", "cumulative")


def with_mean(sums: DataFrame) -> DataFrame:
    return sums.withColumn("mean", F.round(F.col("cumulative") / F.col("total"), 4))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two summaries as one; the order of merging makes no difference."""
    both = left.unionByName(right)
    return with_mean(both.groupBy("tag").agg(*(F.sum(c).alias(c) for c in COUNTS)))


SUMMARY_SQL = """
SELECT tag,
       CAST(sum(CASE WHEN s > 2 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
       CAST(sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
       CAST(sum(CASE WHEN s < 2 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
       CAST(count(*) AS BIGINT) AS total,
       CAST(sum(s) AS BIGINT) AS cumulative,
       round(sum(s) / count(*), 4) AS mean
FROM (SELECT event_type AS tag, CAST(least(4, greatest(0, floor(value / 20))) AS INTEGER) AS s FROM events {where}) t
GROUP BY tag
"""
IS_WATCHED = "WHERE event_type IN ('click', 'purchase', 'view')"


@query("A3", SUMMARY_SQL.format(where=""))
def sentiment_summary(t) -> DataFrame:
    return summarise(scored_posts(t("events")))


@query("P5 R8", SUMMARY_SQL.format(where=IS_WATCHED))
def watched_summary(t) -> DataFrame:
    """The filter stands before the scan's other work, so it is pushed into it."""
    return summarise(scored_posts(t("events").where(F.col("event_type").isin(*WATCHED))))


@query("U1 U2 V5", SUMMARY_SQL.format(where=""))
def bag_union_state(t) -> DataFrame:
    """A stored state and a new batch, united as bags and summed again."""
    events = t("events")
    old = summarise(scored_posts(events.where("event_id % 3 <> 0"))).drop("mean")
    new = summarise(scored_posts(events.where("event_id % 3 = 0"))).drop("mean")
    return merge(old, new)


@query("K15", f"SELECT tag, positive, neutral, negative, total, CAST(max(total) OVER () AS BIGINT) AS y_max FROM ({SUMMARY_SQL.format(where='')}) s ORDER BY total DESC, tag")
def dashboard_rows(t) -> DataFrame:
    """The stacked counts as the dashboard orders them, with the height of its axis."""
    rows = summarise(scored_posts(t("events")))
    highest = F.broadcast(rows.agg(F.max("total").alias("y_max")))  # one row
    return rows.join(highest).select("tag", "positive", "neutral", "negative", "total", "y_max").orderBy(F.desc("total"), "tag")
