"""Deal-board queries."""

from __future__ import annotations

from souk.operators import deals as D
from souk.operators import prices as P
from souk.plans.q_prices import SCORED_CTES
from souk.plans.registry import register
from souk.sources import views as V

PCT = "COALESCE(CAST(claimed_c - actual_c AS DOUBLE) / NULLIF(CAST(claimed_c AS DOUBLE), 0) * 100, 0)"
BEST = f"""
    SELECT product, seller,
           arg_min(date, (-pct, date, order_key, line_no, part_id, supp_id)) AS date,
           arg_min(claimed_c, (-pct, date, order_key, line_no, part_id, supp_id)) AS claimed_c,
           arg_min(actual_c, (-pct, date, order_key, line_no, part_id, supp_id)) AS actual_c,
           arg_min(pct, (-pct, date, order_key, line_no, part_id, supp_id)) AS pct,
           arg_min(is_manipulation, (-pct, date, order_key, line_no, part_id, supp_id)) AS is_manipulation,
           arg_min((date, order_key, line_no, part_id, supp_id), (-pct, date, order_key, line_no, part_id, supp_id)) AS k
    FROM (SELECT *, {PCT} AS pct FROM s) GROUP BY product, seller"""
MARKET = "SELECT product, sum(actual_c) AS sum_c, count(*) AS n FROM s GROUP BY product"
CTES = dict(SCORED_CTES, best=BEST, market=MARKET)


@register("win_04_best_deal_per_seller", V.with_views("""
    SELECT b.product, b.seller, b.date,
           CAST(actual_c AS DOUBLE) / 100 AS current_price, CAST(claimed_c AS DOUBLE) / 100 AS original_price,
           round_even(pct * 10, 0) / 10 AS discount_pct,
           CASE WHEN is_manipulation THEN 'Fake Discount - Do Not Buy'
                WHEN actual_c * n > sum_c THEN 'Wait for Drop'
                WHEN actual_c * 10 * n <= sum_c * 9 THEN 'Best Buy (Highly Recommended)'
                ELSE 'Good Deal' END AS ai_recommendation,
           CASE WHEN is_manipulation THEN 'danger' WHEN actual_c * n > sum_c THEN 'warning' ELSE 'success' END AS status_color,
           is_manipulation
    FROM best b JOIN market m USING (product)""", "prices", extra=CTES))
def win_04_best_deal_per_seller(spark, sf_dir):
    """WIN-04 + FN-17: each seller's best historical deal with the advice text."""
    return D.deal_rows(P.scored_quotes(spark, sf_dir))


@register("agg_20_deal_board", V.with_views("""
    SELECT product, best_price, best_seller, avg_price, avg_discount_pct, deal_score, has_manipulation, sellers,
           CASE WHEN deal_score >= 80 THEN 'Buy Now' WHEN deal_score >= 50 THEN 'Good Deal' ELSE 'Wait / Fake' END AS recommendation,
           CASE WHEN deal_score >= 80 THEN 'Excellent Deal' WHEN deal_score >= 50 THEN 'Average Deal' ELSE 'Poor Deal' END AS badge
    FROM (
      SELECT product, CAST(best_c AS DOUBLE) / 100 AS best_price, best_seller,
             round_even(CAST(sum_c AS DOUBLE) / n / 100 * 100, 0) / 100 AS avg_price,
             round_even(avg_pct * 10, 0) / 10 AS avg_discount_pct,
             round_even((least(greatest(100.0::DOUBLE - CAST(best_c AS DOUBLE) / (CAST(sum_c AS DOUBLE) / n) * 50, 0.0::DOUBLE), 100.0::DOUBLE)
                        - CASE WHEN has_manipulation THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END) * 10, 0) / 10 AS deal_score,
             has_manipulation, sellers
      FROM (SELECT product, min(actual_c) AS best_c,
                   arg_min(seller, (actual_c, -pct, k)) AS best_seller, avg(pct) AS avg_pct,
                   bool_or(is_manipulation) AS has_manipulation, count(*) AS sellers
            FROM best GROUP BY product) JOIN market USING (product))""", "prices", extra=CTES))
def agg_20_deal_board(spark, sf_dir):
    """AGG-20 + FN-16 + FN-18: the deal board for every product."""
    return D.deal_board(P.scored_quotes(spark, sf_dir))
