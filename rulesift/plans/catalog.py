"""Registry of named queries and their DuckDB-runnable SQL twins.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
views Spark derives from them); its SQL twin reads the same tables under the
same names and returns the same columns. Queries without a SQL twin are
checked by row count and by invariant tests.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulesift.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``. The registered callable first makes sure
    the session names a checkpoint folder (read from the session; a scratch
    one is set only when it is unset, as in tests and local checks)."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from rulesift.plans import (  # noqa: F401
        explore_queries, ingest_queries, invariant_queries, jobs_queries, ml_queries, rounds_queries,
        rules_queries, state_queries, store_queries,
    )
