"""Property checks from the test strategy: flags imply a discount, the fill leaves no gap
after the first quote, the split is a partition, percentages and scores stay in range, and
the skew-safe series path equals the plain window when one series holds a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.operators import deals as D
from souk.operators import prices as P
from souk.operators import reviews as R
from souk.operators import text as T
from souk.operators.series import block_cuts, day_counts, rolling_rows
from souk.sources import views as V


def test_flags_imply_discount(spark, sf):
    s = P.scored(V.prices(spark, sf))
    assert s.filter("is_manipulation AND claimed_c <= actual_c").count() == 0


def test_fill_has_no_gap_after_first_quote(spark, sf):
    f = P.filled_series(V.prices(spark, sf))
    first = f.filter(F.col("last_c").isNotNull()).groupBy("product", "seller").agg(F.min("date").alias("d0"))
    gaps = f.join(first, ["product", "seller"]).filter((F.col("date") >= F.col("d0")) & F.col("filled_c").isNull())
    assert gaps.count() == 0


def test_split_is_a_partition(spark, sf):
    r = V.reviews(spark, sf, with_text=False)
    s = T.split(r, "id", 80)
    assert s.count() == r.count()
    assert s.filter(~F.col("split").isin("train", "test")).count() == 0
    again = T.split(r.repartition(3), "id", 80)
    assert s.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_ranges(spark, sf):
    d = R.distribution(V.reviews(spark, sf, with_text=False))
    for c in ("positive_pct", "neutral_pct", "negative_pct"):
        assert d.filter((F.col(c) < 0) | (F.col(c) > 100)).count() == 0
    board = D.deal_board(P.scored(V.prices(spark, sf)))
    assert board.filter((F.col("deal_score") < -30) | (F.col("deal_score") > 100)).count() == 0


def test_hot_series_is_split_and_equals_window(spark, sf):
    """One (product, seller) holding a third of all quotes: cut into many blocks, with the same rows."""
    p = V.prices(spark, sf)
    hot = p.withColumn("seller", F.when(F.col("order_key") % 3 == 0, F.lit("HOT")).otherwise(F.col("seller"))) \
           .withColumn("product", F.when(F.col("seller") == "HOT", F.lit("Brand#HOT")).otherwise(F.col("product")))
    keys, order = ["product", "seller"], list(P.ORDER)
    cuts = block_cuts(day_counts(hot, keys, order), keys, 100)
    assert cuts.where("seller = 'HOT'").agg(F.sum(F.size("_cuts"))).first()[0] >= 15
    w = Window.partitionBy(*keys).orderBy(*order)
    a = hot.withColumns({"s": F.sum("actual_c").over(w.rowsBetween(-6, 0)), "n": F.count(F.lit(1)).over(w.rowsBetween(-6, 0))})
    b = rolling_rows(hot, keys, order, 7, {"s": "actual_c"}, count_col="n", cuts=cuts)
    cols = keys + order + ["s", "n"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.count() == p.count()


def test_pivot_fails_on_a_seller_without_a_column(spark, sf):
    prices = V.prices(spark, sf)
    sellers = sorted(r["seller"] for r in prices.select("seller").distinct().collect())
    assert P.pivot_first_price(prices, sellers).columns == ["product", "date", *sellers]
    with pytest.raises(Exception, match="no column for seller " + sellers[-1]):
        P.pivot_first_price(prices, sellers[:-1]).collect()


def test_profile_sketches_stay_within_their_bounds(spark):
    from souk.operators.reviews import column_profile, first_rows
    n = 50_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % 1000).cast("string").alias("s"),
                               F.when(F.col("id") % 4 > 0, F.col("id") / 3).alias("x"))
    rows = {r["column"]: r for r in column_profile(df, sketches=True).collect()}
    for c, distinct in (("v", n), ("s", 1000), ("x", n * 3 // 4)):
        assert abs(rows[c].approx_distinct - distinct) <= 5 * 0.02 * distinct
    assert all(abs(q - k * n / 4) <= n / 10_000 + 1 for k, q in zip((1, 2, 3), rows["v"].approx_quartiles, strict=True))
    assert (rows["x"].nulls, rows["x"].rows, rows["v"].min, rows["v"].max, rows["v"]["mean"]) == (n // 4, n, "0", str(n - 1), (n - 1) / 2)
    assert rows["s"].approx_quartiles is None and rows["s"]["mean"] is None
    halves = [column_profile(df.where(f"v % 2 = {k}"), sketches=True).where("column = 'v'").first() for k in (0, 1)]
    assert sum(r.rows for r in halves) == n
    assert [r.v for r in first_rows(df, ["v"], 3).collect()] == [0, 1, 2]
    assert column_profile(df.limit(0)).where("rows > 0").count() == 0
