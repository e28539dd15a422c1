"""The registered queries: their columns, and the oracle SQL of those that have one."""

from __future__ import annotations

import pytest
from compare import bag

from quillmere.llm import queries

COLUMNS = {
    "op1_packing": ["doc_id:bigint", "piece:int", "start:bigint", "length:bigint", "ids_crc32:bigint", "sequence_id:bigint", "offset:bigint"],
    "op2_bpe": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
    "op3_language": ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"],
    "op4_suffix_dedup": ["doc_id:bigint", "n_bytes:bigint", "n_removed:bigint", "n_spans:bigint", "kept_sha256:string"],
    "op5_quality_rules": ["doc_id:bigint", "n_words:bigint", "word_chars:bigint", "n_symbols:bigint", "n_dup_lines:bigint", "n_repeat_words:bigint", "base_failed:boolean", "kept:boolean"],
    "op6_jaccard_join": ["doc_id:bigint", "n_shingles:bigint", "component_id:bigint"],
    "op7_exact_dedup": ["doc_id:bigint", "keep_id:bigint", "group_size:bigint", "kept:boolean", "text_sha256:string"],
    "op8_quality_classifier": ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"],
    "op9_sharding": ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"],
    "op10_license_scan": ["doc_id:bigint", "n_matches:bigint", "license:string", "coverage:double"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    kinds = [f"{c}:{t}" for c, t in found.dtypes]
    assert kinds[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    if name != "op1_packing":
        assert found.select("doc_id").distinct().count() == found.count() == 200
    if name in queries.ORACLE_SQL:
        assert found.count() == 200


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    result = duck.sql(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.columns, found.collect()) == bag(columns, result.fetchall())
