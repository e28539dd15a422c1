"""The catalogue: importing the modules of queries fills it."""

from __future__ import annotations

from quillmere.operators import analytics, edges, features, models, summary, text, warehouse
from quillmere.plans.registry import CATALOG
from quillmere.sources import images, roundtrips
from quillmere.streaming import queries as streaming

MODULES = (summary, text, edges, warehouse, analytics, features, models, roundtrips, images, streaming)

QUERIES = CATALOG.queries
ORACLE_SQL = CATALOG.oracle
OPERATORS = CATALOG.operators
