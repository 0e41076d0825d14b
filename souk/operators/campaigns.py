"""Campaign tagging and roll-ups (JOIN-05, JOIN-10, FN-26, AGG-21, AGG-30, PRJ-17).

The campaign windows are a literal table of two rows, broadcast by construction. Tagging a
quote with its campaign is an equi-join on month plus a day-range filter, so it is a
broadcast hash join, not a nested loop over the quotes. What a seller charges in a campaign and
which sellers serve a category are measured from the quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.exprs import discount_pct, round_half_even
from souk.operators.series import top_k

# The reference's campaign windows (month, first day, last day).
CAMPAIGN_WINDOWS = [("Black Friday", 11, 20, 30), ("Spring Sale", 4, 10, 20)]


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMPAIGN_WINDOWS, "campaign string, month int, day_from int, day_to int")


def tag_campaigns(prices: DataFrame) -> DataFrame:
    """JOIN-10: quotes inside a campaign window, with the campaign name and its year."""
    w = F.broadcast(windows(prices.sparkSession))
    q = prices.withColumn("_m", F.month("date")).withColumn("_d", F.dayofmonth("date"))
    tagged = q.join(w, (q._m == w.month) & q._d.between(w.day_from, w.day_to)).drop("month", "day_from", "day_to", "_m", "_d")
    return tagged.withColumn("year", F.year("date"))


def campaign_quotes(prices: DataFrame) -> DataFrame:
    """FN-26: quotes of each product, seller and campaign occurrence, and the seasonal rate: the
    selling price as a share of the claimed one, over all the seller's quotes in it (NULL if
    those claim nothing)."""
    t = tag_campaigns(prices)
    rate = F.try_divide(F.sum("actual_c").cast("double"), F.sum("claimed_c").cast("double"))
    return t.groupBy("product", "seller", "campaign", "year").agg(
        F.count(F.lit(1)).alias("quotes"), round_half_even(rate, 4).alias("seller_rate"))


def campaign_rollup(scored_df: DataFrame) -> DataFrame:
    """AGG-21: the ``campaigns`` table the reference declared but never filled: per product,
    seller and campaign occurrence, the largest discount % and whether it was real (no quote
    flagged as a fake discount)."""
    t = tag_campaigns(scored_df).withColumn("_pct", discount_pct("claimed_c", "actual_c"))
    return t.groupBy("product", "seller", F.concat_ws(" ", "campaign", F.col("year").cast("string")).alias("name")).agg(
        round_half_even(F.max("_pct"), 1).alias("discount_percentage"),
        (~F.bool_or("is_manipulation")).cast("int").alias("is_real"),
        F.avg("anomaly_score").alias("_mean_score"),
        F.count(F.lit(1)).alias("quotes"))


def top_campaigns(rollup: DataFrame, k: int = 10) -> DataFrame:
    """AGG-30: the k most manipulative campaign occurrences by mean anomaly score."""
    r = rollup.withColumn("mean_score", round_half_even("_mean_score", 4)).drop("_mean_score")
    order = [F.desc("mean_score"), F.desc("discount_percentage"), F.asc("product"), F.asc("seller"), F.asc("name")]
    return top_k(r, [], order, k, rank_col="rank")


def filter_campaigns(rollup: DataFrame, name_part: str | None = None, fake_only: bool = False) -> DataFrame:
    """PRJ-17: filter the campaign list by name substring and by type."""
    out = rollup
    if name_part:
        out = out.filter(F.lower("name").contains(name_part.lower()))
    if fake_only:
        out = out.filter(F.col("is_real") == 0)
    return out


def eligible_sellers(prices: DataFrame, products: DataFrame, exclusive: dict[str, str] | None = None) -> DataFrame:
    """JOIN-05: category -> sellers that quote a product of it. ``exclusive`` maps a seller to the
    one category it is eligible in. The quotes are reduced to (product id, seller) before the join."""
    quoted = prices.select(F.col("part_id").alias("id"), "seller").distinct()
    out = quoted.join(products.select("id", "category"), "id").select("category", "seller").distinct()
    for seller, category in (exclusive or {}).items():
        out = out.filter((F.col("seller") != seller) | (F.col("category") == category))
    return out
