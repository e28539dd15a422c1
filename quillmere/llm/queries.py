"""The queries of this subpackage, each over its whole table, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, jaccard_join, language, licenses, packing, quality_classifier, quality_rules, sharding, suffix_dedup
from .common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, CAST(2 * i - 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 - 48 AS BIGINT))) AS i FROM d) x),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
k AS (SELECT w.doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM w JOIN m ON m.s = w.s AND m.least < w.doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM k),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
p AS (SELECT d.doc_id, r.a, r.z, substring(h, CAST(2 * coalesce(lag(r.z) OVER (PARTITION BY d.doc_id ORDER BY r.a), 1) - 1 AS BIGINT), CAST(2 * (r.a - coalesce(lag(r.z) OVER (PARTITION BY d.doc_id ORDER BY r.a), 1)) AS BIGINT)) AS piece FROM d JOIN r ON r.doc_id = d.doc_id),
o AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(z) AS z FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN o.doc_id IS NULL THEN h ELSE head || substring(h, CAST(2 * z - 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * k >= 80 * (a.n_shingles + b.n_shingles - k)),
r AS (SELECT doc_id AS i, doc_id AS c FROM n UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.i)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT i, min(c) AS component_id FROM r GROUP BY i) m ON m.i = n.doc_id
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

QUERIES = {"op1_packing": op1_packing, "op2_bpe": op2_bpe, "op3_language": op3_language, "op4_suffix_dedup": op4_suffix_dedup, "op5_quality_rules": op5_quality_rules, "op6_jaccard_join": op6_jaccard_join, "op7_exact_dedup": op7_exact_dedup, "op8_quality_classifier": op8_quality_classifier, "op9_sharding": op9_sharding, "op10_license_scan": op10_license_scan}
# The pipeline is registered beside these by the entry module, as it builds on this package.
ORACLE_SQL = {"op4_suffix_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op7_exact_dedup": OP7_SQL}
