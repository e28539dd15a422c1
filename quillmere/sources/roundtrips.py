"""Readers and writers of files: what is written is read again with a declared schema."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import tokens
from quillmere.functions.transformers import TokenJoiner
from quillmere.plans.registry import session_query
from quillmere.sources.shared import fresh_path
from quillmere.sources.tables import table


@session_query("S7 S8 S11 K8", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment || ', \"' || c_nationkey || '\"' AS note, CAST(c_custkey % 3 AS INTEGER) AS part FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted and escaped fields, line feeds in them, and a key that only the path has."""
    path = fresh_path(spark, "csv")
    note = F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("\n")).alias("c_name"), "c_acctbal", note.alias("note"), (F.col("c_custkey") % 3).cast("int").alias("part"))
    rows.write.partitionBy("part").csv(path, header=True, quote='"', escape='"')
    schema = "c_custkey long, c_name string, c_acctbal double, note string"
    read = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    part = F.regexp_extract(F.input_file_name(), r"part=(\d+)", 1).cast("int")
    return read.select("c_custkey", F.rtrim(F.replace("c_name", F.lit("\n"), F.lit(""))).alias("c_name"), "c_acctbal", "note", part.alias("part"))


@session_query("S2 S12 K1 K2 K9 F7", "SELECT n_name || chr(9) || CAST(n_nationkey AS VARCHAR) AS line, CAST(length(n_name) AS INTEGER) AS letters, n_name || ' x' AS joined FROM nation")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines in a fixed number of files, written in two appends."""
    path = fresh_path(spark, "text")
    lines = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        lines.where(part).select("value").repartition(3, "value").write.mode("append").text(path)
    read = spark.read.text(path, pathGlobFilter="part-*").select(F.col("value").alias("line"), F.split_part("value", F.lit("\t"), F.lit(1)).alias("name"))
    joined = TokenJoiner(inputCol="words", outputCol="joined").transform(read.withColumn("words", F.array("name", F.lit("x"))))
    return joined.select("line", F.length("name").alias("letters"), "joined")


@session_query("K3 K4 K6 S15", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def orc_bucketed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by status, bucketed and sorted by customer; reading one status prunes.

    Rows are dealt by bucket key first, so that each task writes few buckets.
    """
    name = f"quillmere_orders_{fresh_path(spark, '').rsplit('-', 1)[1][:12]}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    dealt = rows.repartition(25, "o_custkey")
    dealt.write.mode("overwrite").format("orc").partitionBy("o_orderstatus").bucketBy(25, "o_custkey").sortBy("o_custkey").saveAsTable(name)
    return spark.table(name).where("o_orderstatus = 'F'")


@session_query("S14 S10", "SELECT c_custkey AS id, c_name AS name, CAST(2 AS INTEGER) AS commits, c_acctbal AS stars FROM customer")
def json_lines_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of tab-joined JSON documents: fields, and the lengths of arrays."""
    path = fresh_path(spark, "json")
    head = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    rest = F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("commits"), F.col("c_acctbal").alias("stars")))
    table(spark, sf_dir, "customer").select(F.concat_ws("\t", head, rest)).write.text(path)
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    one, two = F.get("p", 0), F.get("p", 1)
    return parts.select(
        F.get_json_object(one, "$.id").cast("long").alias("id"), F.get_json_object(one, "$.name").alias("name"),
        F.json_array_length(F.get_json_object(two, "$.commits")).alias("commits"), F.get_json_object(two, "$.stars").cast("double").alias("stars"),
    )


@dataclass(frozen=True)
class Source:
    """A path with the separator of its fields and whether its files begin with names."""

    path: str
    separator: str
    header: bool


def read_all(spark: SparkSession, sources: list[Source], schema: str) -> DataFrame:
    """The rows of several paths, each in its own format, with the number of the path they came by."""
    parts = [spark.read.schema(schema).csv(s.path, sep=s.separator, header=s.header).withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    return functools.reduce(DataFrame.unionByName, parts)


@session_query("S3 S9", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, p_retailprice, CAST(p_partkey % 3 AS INTEGER) AS source FROM part")
def delimited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma, tab and double-colon files, united by a tag of their path."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_retailprice")
    sources = [Source(fresh_path(spark, "delimited"), separator, header) for separator, header in ((",", True), ("\t", False), ("::", False))]
    for i, s in enumerate(sources):
        some = rows.where(F.col("p_partkey") % 3 == i)
        if len(s.separator) == 1:
            some.write.csv(s.path, sep=s.separator, header=s.header)
        else:  # Spark reads separators of several characters, and writes such lines as text
            some.select(F.concat_ws(s.separator, *(F.col(c).cast("string") for c in some.columns)).alias("value")).write.text(s.path)
    return read_all(spark, sources, "p_partkey long, p_brand string, p_retailprice double")


@session_query("K11", r"SELECT doc_id, CAST(len(g) AS INTEGER) AS n_tokens, g[1] AS first_token FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(trim(lower(text)), '\W+', ' ', 'g'), '\d+', '', 'g'), ' '), lambda w: w <> '') AS g FROM documents) d")
def token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are derived once, kept as JSON lines, and read again with a declared schema."""
    path = fresh_path(spark, "tokens")
    table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens")).write.json(path)
    kept = spark.read.schema("doc_id long, tokens array<string>").json(path)
    return kept.select("doc_id", F.size("tokens").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first_token"))
