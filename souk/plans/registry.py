"""Named queries: each is a DataFrame builder ``(spark, sf_dir) -> DataFrame`` plus, where the
result is expressible in SQL, its independent DuckDB twin (used as a correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise KeyError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from souk.plans import (q_prices, q_deals, q_reviews, q_tables, q_campaigns,  # noqa: F401
                            q_text, q_ingest, q_models, q_streams)
    return REGISTRY
