"""Request-style entry points with the original endpoints' parameters.

Each function is a composition of the all-products operators with the request's filters
applied before any shuffle (the product / seller filter is pushed to the scan of the
catalogue side), returning DataFrames instead of JSON. The whole-table forms in
``souk.plans`` remain the way to answer every product at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.exprs import ALL_STORES, optional_eq
from souk.operators import deals as D
from souk.operators import prices as P
from souk.operators import reviews as R
from souk.operators.catalog import resolve_exact, resolve_keyword
from souk.plans.q_tables import stored_analysis
from souk.sources import views as V


def _prices(spark: SparkSession, sf_dir: str, product: str, store: str | None) -> DataFrame:
    p = V.prices(spark, sf_dir).filter(F.col("product") == product)
    return p.filter(optional_eq("seller", store, sentinel=ALL_STORES))


def reviews_page(spark: SparkSession, sf_dir: str, product: str, page: int = 1, limit: int = 10,
                 model_type: str = "bert", search: str | None = None, rating: int | None = None,
                 sentiment: str | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """The review search: one page (newest first) under all filters, and the distribution
    and mean rating under every filter except the sentiment one."""
    col = R.label_column(model_type)
    base = R.with_model_columns(V.reviews(spark, sf_dir)).filter(F.col("product") == product)
    rows = R.search(base, search=search, rating=rating, sentiment=sentiment, store=store, label_col=col)
    pg = R.page(rows.withColumn("sentiment", F.col(col)), page, limit)
    kpi = R.search(base, search=search, rating=rating, store=store, label_col=col)
    dist = R.model_adjusted(R.distribution(kpi, label_col=col), model_type)
    return {"page": pg, "distribution": dist}


def analyze_price(spark: SparkSession, sf_dir: str, product: str, store: str | None = None) -> dict[str, DataFrame]:
    """The price analysis of one product (optionally one seller): flagged quotes with
    confidence, the first-quote grid and the latest-date statistics with commentary."""
    prices = _prices(spark, sf_dir, product, store)
    scored = P.scored(prices, P.price_cuts(spark, sf_dir))
    return {"anomalies": P.anomaly_report(scored).orderBy(F.desc("date"), *[F.desc(c) for c in V.PRICE_TIE]),
            "grid": P.cell_quotes(prices),
            "stats": P.latest_snapshot(prices).join(P.flag_summary(scored), "product"),
            "commentary": P.commentary(scored)}


def stored_anomalies(spark: SparkSession, sf_dir: str, product: str, store: str | None = None) -> DataFrame:
    """The flagged quotes of one product (optionally one seller) from the stored analysis: nothing is
    computed while the price files are the same, and one partition is read."""
    return stored_analysis(spark, sf_dir).read(product).filter(optional_eq("seller", store, sentinel=ALL_STORES))


def campaign_deals(spark: SparkSession, sf_dir: str, product: str, store: str | None = None) -> dict[str, DataFrame]:
    """The deal board of one product: per-seller best deals, the board and the filled series."""
    prices = _prices(spark, sf_dir, product, store)
    scored = P.scored(prices, P.price_cuts(spark, sf_dir))
    return {"deals": D.deal_rows(scored), "stats": D.deal_board(scored), "chart": P.filled_series(prices)}


def product_hub(spark: SparkSession, sf_dir: str, product: str) -> dict[str, DataFrame]:
    """Review summary and price comparison of one product (the brand hub page)."""
    reviews = V.reviews(spark, sf_dir, with_text=False).filter(F.col("product") == product)
    prices = _prices(spark, sf_dir, product, None)
    return {"summary": R.product_summary(reviews), "grid": P.cell_quotes(prices),
            "stats": P.latest_snapshot(prices)}


def find_product(spark: SparkSession, sf_dir: str, keyword: str | None = None, name: str | None = None) -> DataFrame:
    """Product lookup: exact name else substring (``name``), or keyword with fallback."""
    products = V.products(spark, sf_dir)
    return resolve_exact(products, name) if name is not None else resolve_keyword(products, keyword or "")
