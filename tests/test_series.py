import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.operators import prices as P
from souk.operators import series
from souk.operators.series import block_cuts, day_counts, rolling_rows
from souk.plans.registry import load_all
from souk.sources import views as V

ORDER = list(P.ORDER)


def _plain(df, keys, n):
    w = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    return df.select("*", F.sum("actual_c").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("_cnt"))


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def hot_month(spark, sf, rows=20_000):
    """The prices with one product holding nine tenths of a month, a third of that on one day."""
    p = V.prices(spark, sf)
    day = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 28)
    hot = spark.range(rows).select(
        F.lit("Brand#1").alias("product"), F.lit("NATION_1").alias("seller"), F.date_add(F.lit("1997-03-01").cast("date"), day.cast("int")).alias("date"),
        (F.col("id") * 3 + 1).alias("order_key"), F.lit(9).cast("int").alias("line_no"), F.col("id").alias("part_id"), F.col("id").alias("supp_id"),
        (F.col("id") % 977 + 5).alias("claimed_c"), (F.col("id") % 977).alias("actual_c"))
    return p.unionByName(hot.select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in p.columns]))


@pytest.mark.parametrize("bound", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("keys, n", [(["product", "seller"], 7), (["product"], 14)])
def test_blocks_change_no_result(spark, sf, monkeypatch, bound, keys, n):
    monkeypatch.setattr(series, "BLOCK_ROWS", bound)
    p = V.prices(spark, sf).filter("product IN ('Brand#1', 'Brand#2', 'Brand#11')")
    _same(rolling_rows(p, keys, ORDER, n, {"s": "actual_c"}), _plain(p, keys, n))


def test_null_keys_and_null_values(spark, sf, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 5)
    p = (V.prices(spark, sf).withColumn("seller", F.when(F.col("seller") != "NATION_1", F.col("seller")))
         .withColumn("actual_c", F.when(F.col("order_key") % 3 > 0, F.col("actual_c"))))
    _same(rolling_rows(p, ["product", "seller"], ORDER, 7, {"s": "actual_c"}), _plain(p, ["product", "seller"], 7))


def test_no_block_passes_its_bound_where_one_product_holds_a_month(spark, sf):
    bound = 500
    p = hot_month(spark, sf)
    keys = ["product", "seller"]
    cuts = block_cuts(day_counts(p, keys, ORDER), keys, bound)
    place = F.struct(F.col("date").alias("day"), F.col("order_key").alias("at"))
    blocks = p.join(cuts.withColumnsRenamed({k: f"c_{k}" for k in keys}), F.expr("product = c_product AND seller = c_seller AND trunc(date, 'month') = _month"), "left")
    sizes = blocks.groupBy(*keys, F.coalesce(F.col("_base") + F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0)).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * bound
    assert sizes.where("product = 'Brand#1' AND seller = 'NATION_1'").count() >= 20_000 // (2 * bound)
    _same(rolling_rows(p, keys, ORDER, 7, {"s": "actual_c"}, cuts=cuts), _plain(p, keys, 7).select(*p.columns, "s", "_cnt"))


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("== Final Plan =="):text.index("== Initial Plan ==")]


@pytest.mark.parametrize("bound", [100, 1 << 20])
@pytest.mark.parametrize("key", ["fake_discounts", "win_01_rolling_mean", "win_03_rolling14_rule", "win_04_best_deal_per_seller",
                                 "agg_20_deal_board", "src_18_nested_result", "join_06_calendar_spine", "join_08_forward_fill", "fn_21_commentary"])
def test_quotes_are_scanned_once(spark, sf, monkeypatch, key, bound):
    """Window and carried rows come from one exchange, whether series are cut or not."""
    monkeypatch.setattr(series, "BLOCK_ROWS", bound)
    assert final_plan(load_all()[key].build(spark, sf)).count("FileScan parquet [l_orderkey") + \
        final_plan(load_all()[key].build(spark, sf)).count("FileScan parquet [l_partkey") == 1
