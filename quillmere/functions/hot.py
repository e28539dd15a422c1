"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from more than one row in this many; so there are never more hot keys than this.
SHARE = 1_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, of: str, total: int) -> DataFrame:
    """rows.join(small, key), where small has one row for each key, with `of`: how many of at most `total` rows have it.

    The hot keys' part of small, fewer than SHARE rows, is broadcast, so their rows stay where they
    are; all others are shuffled, and none of those is large. A null key joins nothing.
    """
    hot = F.col(of) * SHARE > total
    values = F.struct(*(c for c in small.columns if c not in (key, of))).alias("_hot")
    marked = rows.join(F.broadcast(small.where(hot).select(key, values)), key, "left")
    found = [F.col(f"_hot.{c}") for c in small.columns if c not in (key, of)]
    near = marked.where("_hot IS NOT NULL").select(*rows.columns, *found)
    return near.unionByName(marked.where("_hot IS NULL").drop("_hot").join(small.where(~hot).drop(of), key))
