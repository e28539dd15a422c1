"""Sharding by vector bin packing of bytes, tokens and rows (operator 9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, global_rank

#: Small groups are placed together, by hash, in this many bundles; a group with more than its
#: share of a bundle in any dimension is placed alone. Both bound what the driver plans over.
BUNDLES = 16_384
#: Parts for one shard's worth of a group that no single shard can hold.
PARTS = 8
_WORD = r"[^\x20\x09-\x0D]+"


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; sizes has one row (bytes, tokens, rows) for each.

    Items come in falling order of their largest share of any dimension's total. Each goes to
    the shard, among those that still hold it in every dimension, where the dot product of the
    item with the residual capacity is highest; if none holds it, to the highest dot product of
    all. A residual is a share of the dimension's total, so the dimensions weigh alike.
    """
    totals = np.maximum(sizes.sum(axis=0), 1e-12)
    share = sizes / totals
    residual = np.full((shards, sizes.shape[1]), 1.0 / shards)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        item = share[i]
        score = residual @ item
        holds = (residual >= item).all(axis=1)
        score = np.where(holds, score, -np.inf) if holds.any() else score
        best = int(score.argmax())
        residual[best] -= item
        out[i] = best
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: 1). The law is `bytes`: the shards' sizes are
    near equal, with tokens (words) and rows balanced beside them; grown_shard is null. Documents
    of equal text, null and empty alike, share a shard, unless their group is larger than a shard
    in some dimension: it is then dealt over several by its ids, since keeping it whole would
    break the law. A group with less than 1 / BUNDLES of every total is placed with others, by a
    hash of its text, so that the driver plans over at most 4 * BUNDLES items whatever the table;
    bundles of n groups differ in size by about 1 / sqrt(n) of their mean, and best fit evens
    them out as it does groups. slot numbers a shard's rows from 0 in no promised order. Repeated rows get
    slots of their own; null ids are dealt like any other. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.when(F.length(text) > 0, F.regexp_count(text, F.lit(_WORD))).otherwise(0).cast("long").alias("tokens"),
    )
    base = cut_lineage(base)
    groups = base.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    total = base.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = [max(1, x or 0) for x in total]
    heavy = F.greatest(*(F.col(c) / F.lit(float(n)) for c, n in zip("btr", total, strict=True))) > F.lit(1.0 / BUNDLES)
    items = groups.withColumn("heavy", heavy).withColumn("item", F.when(F.col("heavy"), F.col("group")).otherwise(F.pmod("group", F.lit(BUNDLES))))
    # at most BUNDLES small rows and 3 * BUNDLES heavy ones, however large the table
    rows = items.groupBy("heavy", "item").agg(F.sum("b"), F.sum("t"), F.sum("r")).orderBy("heavy", "item").collect()
    sizes, names = [], []
    for is_heavy, item, *size in rows:
        parts = int(max(1, *(-(-x * shards * PARTS // n) for x, n in zip(size, total, strict=True)))) if is_heavy and any(x * shards > n for x, n in zip(size, total, strict=True)) else 1
        for part in range(parts):
            names.append((bool(is_heavy), int(item), part, parts))
            sizes.append([x / parts for x in size])
    places = place(np.array(sizes, float).reshape(-1, 3), shards)
    spark = docs.sparkSession
    plan = [(*name, int(p)) for name, p in zip(names, places, strict=True)]
    schema = "heavy boolean, item long, part int, parts int, shard int"
    plan_df = spark.createDataFrame(plan, schema)
    alone = plan_df.where("heavy").select(F.col("item").alias("group"), "part", "parts", F.col("shard").alias("own"))
    few = F.broadcast(alone.where("part = 0").select("group", "parts"))
    parted = base.select("doc_id", "size", "text_crc32", "group").join(few, "group", "left")
    parted = parted.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.coalesce("parts", F.lit(1))).cast("int"))
    parted = parted.join(F.broadcast(alone.drop("parts")), ["group", "part"], "left")
    small = plan_df.where("not heavy").select(F.col("item").alias("bundle"), F.col("shard").alias("bundled"))
    parted = parted.withColumn("bundle", F.pmod("group", F.lit(BUNDLES))).join(F.broadcast(small), "bundle", "left")
    placed = parted.select("doc_id", "size", "text_crc32", F.coalesce("own", "bundled").cast("int").alias("shard"))
    slotted = global_rank(cut_lineage(placed), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
