"""Canonical views over the input tables.

The input tables hold no reviews or seller quotes, so each domain table is a stand-in view
derived from them. Every view exists twice: as a DataFrame builder (what the operators use)
and as SQL text (what ``oracle_sql`` embeds as a CTE for the independent DuckDB check).
The two must stay in lock-step; ``tests/test_oracle.py`` compares every query built on them.

products  <- part
prices    <- lineitem |x| part |x| supplier |x| nation   (series key: product = brand, seller = nation)
reviews   <- documents left-join labels
ticks     <- events
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.exprs import cents, sentiment_of_rating, utc_instant
from souk.sources.tables import read

# Row tie-break for every ordering of price quotes: unique per lineitem row.
PRICE_TIE = ("order_key", "line_no", "part_id", "supp_id")
SERIES = ("product", "seller")
REVIEW_EPOCH = "2024-01-01"
N_REVIEW_PRODUCTS = 25


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("base_price"),
        cents("p_retailprice").alias("base_c"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
    )


def with_seller(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """``rows`` with the seller (``n_name``) of the supplier in ``key``. nation has 25 rows by definition of
    the schema, so it is broadcast; supplier grows with the data, so its join is left to the planner, which
    broadcasts by the byte size it knows (spark.sql.autoBroadcastJoinThreshold). The rows meet supplier
    itself, not its join with nation: of a join the planner knows no size but the product of both."""
    sup = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nat = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return rows.join(sup, rows[key] == sup.s_suppkey).join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)


def prices(spark: SparkSession, sf_dir: str, base: bool = False) -> DataFrame:
    """One row per quote: (product, seller, date, tie...) with claimed/actual in BIGINT cents; with ``base``
    also the product's list price (``base_c``), from the same join."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", *(["p_retailprice"] if base else []))
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    unit_net = F.try_divide(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity"))
    return (with_seller(li.join(part, li.l_partkey == part.p_partkey), spark, sf_dir, "l_suppkey")
              .select(F.col("p_brand").alias("product"),
                      F.col("n_name").alias("seller"),
                      F.col("l_shipdate").cast("date").alias("date"),
                      F.col("l_orderkey").alias("order_key"),
                      F.col("l_linenumber").alias("line_no"),
                      F.col("l_partkey").alias("part_id"),
                      F.col("l_suppkey").alias("supp_id"),
                      cents(unit).alias("claimed_c"),
                      cents(unit_net).alias("actual_c"),
                      *([cents("p_retailprice").alias("base_c")] if base else [])))


def reviews_from(docs: DataFrame, labels: DataFrame, with_text: bool = True) -> DataFrame:
    """The reviews view over any documents frame (batch or stream) and the labels table."""
    rating = (F.when(F.col("toxic") == 1, F.lit(1))
               .when(F.col("quality") == 0, F.lit(3))
               .when(F.col("quality") == 1, F.lit(4) + F.col("doc_id") % 2)
               .otherwise(F.lit(None))).cast("int")
    out = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Brand#"), (F.col("doc_id") % N_REVIEW_PRODUCTS + 1).cast("string")).alias("product"),
        F.col("source").alias("store"),
        *([F.col("text").alias("review_text")] if with_text else []),
        rating.alias("review_rating"),
        F.date_add(F.lit(REVIEW_EPOCH).cast("date"), (F.col("doc_id") % 365).cast("int")).alias("review_date"),
        F.col("lang"),
    )
    return out.withColumn("sentiment", sentiment_of_rating("review_rating"))


def reviews(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    cols = ["doc_id", "lang", "source"] + (["text"] if with_text else [])
    docs = read(spark, sf_dir, "documents", *cols)
    lab = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return reviews_from(docs, lab, with_text)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ev.select(F.col("event_id"), utc_instant("ts").alias("ts"), F.col("user_id"),
                     F.col("event_type").alias("seller"), F.col("value").alias("price"))


# ---------------------------------------------------------------------------------------
# The same views as SQL (DuckDB dialect) for the oracle.

SQL_VIEWS = {
    "products": """
        SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS brand,
               p_retailprice AS base_price,
               CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS base_c,
               (p_size % 10 <> 0) AS is_active
        FROM part""",
    "prices": """
        SELECT p.p_brand AS product, n.n_name AS seller, CAST(l.l_shipdate AS DATE) AS date,
               l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_id,
               l.l_suppkey AS supp_id,
               CAST(round_even(l.l_extendedprice / l.l_quantity * 100, 0) AS BIGINT) AS claimed_c,
               CAST(round_even(l.l_extendedprice * (1 - l.l_discount) / l.l_quantity * 100, 0) AS BIGINT) AS actual_c
        FROM lineitem l
        JOIN part p ON l.l_partkey = p.p_partkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "reviews": f"""
        SELECT d.doc_id AS id, 'Brand#' || CAST(d.doc_id % {N_REVIEW_PRODUCTS} + 1 AS VARCHAR) AS product,
               d.source AS store, d.text AS review_text,
               CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 0 THEN 3
                         WHEN l.quality = 1 THEN 4 + d.doc_id % 2 END AS INTEGER) AS review_rating,
               DATE '{REVIEW_EPOCH}' + CAST(d.doc_id % 365 AS INTEGER) AS review_date,
               d.lang,
               CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 0 THEN 'Neutral'
                    WHEN l.quality = 1 THEN 'Positive' END AS sentiment
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "ticks": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS seller, value AS price
        FROM events""",
}


def with_views(sql: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views (and any extra named CTEs, in order)."""
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
