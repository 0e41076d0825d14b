"""Campaign queries."""

from __future__ import annotations

from souk.operators import campaigns as K
from souk.operators import prices as P
from souk.plans.q_prices import SCORED_CTES
from souk.plans.registry import register
from souk.sources import views as V

WINDOWS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {m}, {a}, {b})" for n, m, a, b in K.CAMPAIGN_WINDOWS) + ") w(campaign, month, day_from, day_to)"
TAGGED_SQL = """
    SELECT s.*, w.campaign, CAST(year(s.date) AS INTEGER) AS year
    FROM s JOIN cw w ON month(s.date) = w.month AND day(s.date) BETWEEN w.day_from AND w.day_to"""
PCT = "COALESCE(CAST(claimed_c - actual_c AS DOUBLE) / NULLIF(CAST(claimed_c AS DOUBLE), 0) * 100, 0)"
ROLLUP_SQL = f"""
    SELECT product, seller, campaign || ' ' || CAST(year AS VARCHAR) AS name,
           round_even(max({PCT}) * 10, 0) / 10 AS discount_percentage,
           CAST(NOT bool_or(is_manipulation) AS INTEGER) AS is_real,
           avg(CASE WHEN is_manipulation THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) AS mean_score_raw,
           count(*) AS quotes
    FROM t GROUP BY product, seller, campaign, year"""
CTES = dict(SCORED_CTES, cw=WINDOWS_SQL, t=TAGGED_SQL, c=ROLLUP_SQL)


def _rollup(spark, sf_dir):
    return K.campaign_rollup(P.scored_quotes(spark, sf_dir))


@register("join_10_campaign_quotes", V.with_views("""
    SELECT product, seller, campaign, year, count(*) AS quotes,
           round_even(CAST(sum(actual_c) AS DOUBLE) / NULLIF(CAST(sum(claimed_c) AS DOUBLE), 0) * 10000, 0) / 10000 AS seller_rate
    FROM t GROUP BY product, seller, campaign, year""", "prices", extra=CTES))
def join_10_campaign_quotes(spark, sf_dir):
    """JOIN-10 + FN-26: quotes inside campaign windows with the rate the seller applied there."""
    return K.campaign_quotes(V.prices(spark, sf_dir))


@register("agg_21_campaign_rollup", V.with_views("""
    SELECT product, seller, name, discount_percentage, is_real, quotes FROM c""", "prices", extra=CTES))
def agg_21_campaign_rollup(spark, sf_dir):
    """AGG-21: the campaigns table (max discount, real or fake) per product/seller/campaign."""
    return _rollup(spark, sf_dir).drop("_mean_score")


@register("agg_30_top_campaigns", V.with_views("""
    SELECT product, seller, name, discount_percentage, is_real, quotes, mean_score, rank FROM (
      SELECT *, CAST(row_number() OVER (ORDER BY mean_score DESC, discount_percentage DESC, product, seller, name) AS INTEGER) AS rank
      FROM (SELECT *, round_even(mean_score_raw * 10000, 0) / 10000 AS mean_score FROM c))
    WHERE rank <= 10""", "prices", extra=CTES))
def agg_30_top_campaigns(spark, sf_dir):
    """AGG-30: the 10 most manipulative campaigns by mean anomaly score."""
    return K.top_campaigns(_rollup(spark, sf_dir), 10)


@register("prj_17_campaign_filter", V.with_views("""
    SELECT product, seller, name, discount_percentage, is_real, quotes FROM c
    WHERE contains(lower(name), 'black') AND is_real = 0""", "prices", extra=CTES))
def prj_17_campaign_filter(spark, sf_dir):
    """PRJ-17: campaign list filtered by name substring and type (fake only)."""
    return K.filter_campaigns(_rollup(spark, sf_dir), "black", fake_only=True).drop("_mean_score")


EXCLUSIVE = {"NATION_3": "ECONOMY"}      # this seller serves one category only


@register("join_05_eligible_sellers", V.with_views("""
    SELECT DISTINCT p.category, q.seller FROM prices q JOIN products p ON p.id = q.part_id
    WHERE q.seller <> 'NATION_3' OR p.category = 'ECONOMY'""", "prices", "products"))
def join_05_eligible_sellers(spark, sf_dir):
    """JOIN-05: category -> sellers that quote it, minus the exclusion of a one-category seller."""
    return K.eligible_sellers(V.prices(spark, sf_dir), V.products(spark, sf_dir), EXCLUSIVE)
