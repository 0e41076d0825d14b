"""The deal board (AGG-20, WIN-04, FN-16, FN-17, FN-18): per product, each seller's best
historical deal, the market mean, the best price and a 0..100 deal score, computed for all
products in one pass. Every step is an aggregate (map-side partial), so a seller or product
holding a large share of the quotes does not concentrate in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import DEAL_PENALTY, discount_pct, money, round_half_even
from souk.sources.views import PRICE_TIE

# Advice texts, colours and score tiers shown by the reference.
FAKE_ADVICE = ("Fake Discount - Do Not Buy", "danger")
WAIT_ADVICE = ("Wait for Drop", "warning")
BEST_ADVICE = ("Best Buy (Highly Recommended)", "success")
GOOD_ADVICE = ("Good Deal", "success")
TIERS = ((80, "Buy Now", "Excellent Deal"), (50, "Good Deal", "Average Deal"))
LOW_TIER = ("Wait / Fake", "Poor Deal")


def best_deals(scored_df: DataFrame) -> DataFrame:
    """WIN-04: each seller's quote with the largest discount %; ties go to the earliest quote. The same
    aggregate carries the sum and the number of the seller's quotes, which make up the market mean,
    so the quotes are read once. The least struct is the best deal: its first fields are the order,
    the others travel with it."""
    rows = scored_df.withColumn("_pct", discount_pct("claimed_c", "actual_c"))
    deal = F.struct((-F.col("_pct")).alias("_k"), "date", *PRICE_TIE, "claimed_c", "actual_c", "_pct", "is_manipulation")
    best = rows.groupBy("product", "seller").agg(F.min(deal).alias("_best"), F.sum("actual_c").alias("_seller_c"), F.count(F.lit(1)).alias("_seller_n"))
    return best.select("product", "seller", *[f"_best.{c}" for c in ("date", *PRICE_TIE, "claimed_c", "actual_c", "_pct", "is_manipulation")], "_seller_c", "_seller_n")


def advice(cur="actual_c", flag="is_manipulation", s="_sum_c", n="_n"):
    """FN-17: ordered advice rules against the market mean (sum/n), in integer arithmetic."""
    cur, flag, s, n = (F.col(c) if isinstance(c, str) else c for c in (cur, flag, s, n))
    rule = (F.when(flag, F.array(*map(F.lit, FAKE_ADVICE)))
             .when(cur * n > s, F.array(*map(F.lit, WAIT_ADVICE)))
             .when(cur * 10 * n <= s * 9, F.array(*map(F.lit, BEST_ADVICE)))
             .otherwise(F.array(*map(F.lit, GOOD_ADVICE))))
    return rule


def deal_rows(scored_df: DataFrame) -> DataFrame:
    """Per (product, seller): the best deal with price, list price, discount and advice."""
    market = Window.partitionBy("product")     # over one row per seller
    b = best_deals(scored_df).withColumns({"_sum_c": F.sum("_seller_c").over(market), "_n": F.sum("_seller_n").over(market)})
    a = advice()
    return b.select(
        "product", "seller", "date",
        money("actual_c").alias("current_price"), money("claimed_c").alias("original_price"),
        round_half_even("_pct", 1).alias("discount_pct"),
        a[0].alias("ai_recommendation"), a[1].alias("status_color"), "is_manipulation")


def deal_score(best_c, avg_c, any_fake) -> F.Column:
    """FN-16: clamp(100 - best/avg x 50, 0, 100), then -30 if any best deal is fake (quirk
    Q14: the penalty comes after the clamp, so the score can reach -30)."""
    raw = F.lit(100.0) - best_c / avg_c * 50
    clamped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))
    return clamped - F.when(any_fake, F.lit(float(DEAL_PENALTY))).otherwise(F.lit(0.0))


def score_tier(score) -> tuple[F.Column, F.Column]:
    """FN-18: recommendation and badge for a deal score."""
    (t1, r1, b1), (t2, r2, b2) = TIERS
    rec = F.when(score >= t1, F.lit(r1)).when(score >= t2, F.lit(r2)).otherwise(F.lit(LOW_TIER[0]))
    badge = F.when(score >= t1, F.lit(b1)).when(score >= t2, F.lit(b2)).otherwise(F.lit(LOW_TIER[1]))
    return rec, badge


def deal_board(scored_df: DataFrame) -> DataFrame:
    """AGG-20: one row per product with the board's statistics and tier."""
    b = best_deals(scored_df)
    per = b.groupBy("product").agg(
        F.min_by(F.struct("actual_c", "seller"),
                 F.struct("actual_c", (-F.col("_pct")).alias("k"), "date", *PRICE_TIE)).alias("best"),
        F.avg("_pct").alias("_avg_pct"),
        F.bool_or("is_manipulation").alias("has_manipulation"),
        F.count(F.lit(1)).alias("sellers"), F.sum("_seller_c").alias("_sum_c"), F.sum("_seller_n").alias("_n"))
    best_c = F.col("best.actual_c").cast("double")
    avg_c = F.col("_sum_c").cast("double") / F.col("_n")
    score = deal_score(best_c, avg_c, F.col("has_manipulation"))
    j = per.withColumn("_score", score)
    rec, badge = score_tier(F.col("_score"))
    return j.select(
        "product",
        money("best.actual_c").alias("best_price"),
        F.col("best.seller").alias("best_seller"),
        round_half_even(avg_c / 100, 2).alias("avg_price"),
        round_half_even("_avg_pct", 1).alias("avg_discount_pct"),
        round_half_even("_score", 1).alias("deal_score"),
        "has_manipulation", "sellers",
        rec.alias("recommendation"), badge.alias("badge"))
