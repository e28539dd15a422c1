"""Named queries: what each computes in Spark, the same in oracle SQL, and the operators it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillmere.sources.tables import table

Tables = Callable[[str], DataFrame]


@dataclass
class Catalog:
    """Queries by name, in order of registration."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracle: dict[str, str] = field(default_factory=dict)
    operators: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def query(self, operators: str, sql: str | None = None) -> Callable:
        """Registers a function of the tables under its own name."""

        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            name = build.__name__
            self.queries[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
            self.operators[name] = tuple(operators.split())
            if sql:
                self.oracle[name] = sql
            return build

        return register

    def session_query(self, operators: str, sql: str | None = None) -> Callable:
        """Registers a function of (session, sf_dir), for queries that read files or streams."""

        def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
            name = build.__name__
            self.queries[name] = build
            self.operators[name] = tuple(operators.split())
            if sql:
                self.oracle[name] = sql
            return build

        return register


CATALOG = Catalog()
query, session_query = CATALOG.query, CATALOG.session_query
