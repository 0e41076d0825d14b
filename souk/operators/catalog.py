"""Catalogue lookups (PRJ-12, PRJ-13, SRC-08): resolve a product by keyword or name as one
aggregate over the whole catalogue (no driver loop over products)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_keyword(products: DataFrame, keyword: str) -> DataFrame:
    """PRJ-12: first product (by id) whose lower-cased name starts with or contains the
    keyword; the first product overall when none matches. One row."""
    k = keyword.lower().strip()
    low = F.lower("name")
    hit = low.startswith(k) | low.contains(k)
    row = F.struct("id", "name")
    agg = products.agg(F.min_by(F.when(hit, row), F.when(hit, F.col("id"))).alias("m"),
                       F.min_by(row, F.col("id")).alias("f"))
    return agg.select(F.coalesce("m.id", "f.id").alias("id"), F.coalesce("m.name", "f.name").alias("name"),
                      F.col("m.id").isNotNull().alias("matched"))


def resolve_exact(products: DataFrame, name: str) -> DataFrame:
    """PRJ-13: exact name first, else a case-insensitive substring match; first by id.
    No row when nothing matches. The name 'all' is the first product."""
    if name.strip().lower() == "all":
        return products.orderBy("id").limit(1).select("id", "name", F.lit(0).alias("match_rank"))
    exact = F.col("name") == F.lit(name)
    cand = products.filter(exact | F.col("name").ilike(f"%{name}%")).withColumn(
        "rk", F.when(exact, 0).otherwise(1))
    return cand.groupBy().agg(F.min_by("id", F.struct("rk", "id")).alias("id"),
                              F.min_by("name", F.struct("rk", "id")).alias("name"),
                              F.min("rk").alias("match_rank")).filter(F.col("match_rank").isNotNull())
