"""The training-data pipeline: stages over `documents`, each written and read again.

Documents that the quality rules reject go; of equal texts the largest id stays, of similar ones
the smallest; passages that an earlier document has are cut out; what is left is packed into
sequences of token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from quillmere.llm.common import doc_key, documents
from quillmere.sources.shared import fresh_path, remove


def _whole(docs: DataFrame, **beside: Column) -> DataFrame:
    """Each row of docs as one value `row`, beside helper columns: no name of the caller's can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in beside.items()))


def _one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of those with equal keys, the one with the least hash of all its columns.

    The rows come from a join on the same keys, so they are dealt already.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, as they are.

    Null and empty texts have too few words and go. Texts of any length are judged whole. Each
    row is judged for itself, so repeated rows stay or go together, as do ties of ids; a null id
    makes no difference. Other columns, whatever their names, are passed on. No rows give none.
    """
    return quality_rules.keep_good(docs, documents(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, with the largest id; of rows that repeat id and text, one.

    A null text counts as empty, so null and empty texts are copies of each other. A null id is
    the smallest. Texts of any length are compared by SHA-256 of the whole. Of rows with equal id
    and text the one with the least hash of its columns stays. Other columns are passed on. No
    rows give none. Texts are shuffled once, by digest and id: copies that a third of all rows
    are go to many tasks, since their ids differ.
    """
    live = exact_dedup.live_groups(exact_dedup.digests(docs)).select("digest", doc_key("keep_id").alias("key"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    # a null id is the smallest here, and doc_key's greatest: equal keys are all that counts
    return _one_of_each(_whole(docs, digest=digest, key=doc_key()).join(live, ["digest", "key"]), "digest", "key")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, with the smallest id; of rows that repeat it, one.

    Texts without words, null among them, are similar to nothing, and stay. A null id counts as
    the largest. Of different texts with that id, the one with the least key stays; rows with an
    id in common are told apart by their texts. Texts of any length are compared whole. Other
    columns are passed on. No rows give none.
    """
    first = jaccard_join.similar_groups(docs).where("first").select(doc_key().alias("key"), "text_key").distinct()
    rows = _whole(docs, key=doc_key(), text_key=jaccard_join.text_key(F.coalesce(F.col("text"), F.lit(""))))
    return _one_of_each(rows.join(first, ["key", "text_key"]), "key", "text_key")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that one with a smaller id has; one of which nothing is left goes.

    A row that loses nothing is passed on as it is, a null or empty text among them; otherwise
    text and n_chars are what is left. Rows with equal ids take nothing from each other, so
    repeated rows stay alike. A null id counts as the largest. Texts of any length are judged
    whole. Other columns are passed on. No rows give none.
    """
    found = suffix_dedup.remove_repeats(docs, as_text=True).where("n_removed = 0 OR kept <> ''")
    left = found.select(doc_key().alias("key"), "text_key", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept")).groupBy("key", "text_key").agg(F.first("kept").alias("kept"))
    rows = _whole(docs, key=doc_key(), text_key=suffix_dedup.text_key()).join(left, ["key", "text_key"])
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    cut = F.col("kept").isNotNull()
    return rows.select(*(F.when(cut, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, as one row for each piece of a document.

    A null or empty text is a piece of one token, the end; a long one has several pieces.
    Repeated rows and null ids are packed each for itself. Other columns are not read. No rows
    give none.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", passages), ("best-fit packing", pack)]

#: The first stage's verdict comes from a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`. A stage's table goes when the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
