"""Small tables of documents with every kind of odd row."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import make_rows  # noqa: E402

@pytest.fixture
def frame(spark):
    def build(rows, parts: int = 3):
        # extra columns, some named as the operators name theirs
        schema = "doc_id long, text string, kept string, size int, digest string, shard string, key string, n long, component_id string, lang string"
        wide = [(d, t, "x", 1, "d", "s", "k", 5, "c", None) for d, t in rows]
        return spark.createDataFrame(wide, schema).repartition(parts) if wide else spark.createDataFrame([], schema)

    return build


@pytest.fixture
def odd_rows():
    return make_rows(11)
