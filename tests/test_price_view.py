"""Plans of the price view: what the quotes are shuffled for."""

import pytest
from pyspark.sql import functions as F

from souk.plans.registry import load_all
from souk.sources import views as V
from souk.sources.tables import read


@pytest.fixture
def small_threshold(spark):
    """Each dimension is below the planner's threshold, the product of two of them is not: as with 6 times
    sf0.1 and the default."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "100k")
    yield
    spark.conf.set(key, was)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotes_are_not_shuffled_for_their_seller(spark, sf, small_threshold):
    """Supplier joined with nation was taken to be as large as their product, so all quotes were shuffled
    by supplier, in each of a query's price views."""
    plan = _plan(V.prices(spark, sf))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert V.prices(spark, sf).count() == read(spark, sf, "lineitem").count() > 0
    plan = _plan(load_all()["src_15_child_tables"].build(spark, sf))
    assert "hashpartitioning(l_suppkey" not in plan


def test_price_rows_join_the_products_once(spark, sf):
    """The list price was joined to the rolled quotes: a second join with part, of all of them."""
    from souk.plans import q_models as Q
    made = Q._made_price_rows(spark, sf)
    joins = [x for x in _plan(made).splitlines() if "Join" in x and "part" in x]
    assert joins and all("l_partkey" in x for x in joins)
    base = V.products(spark, sf).select(F.col("id").alias("part_id"), "base_c")
    want = V.prices(spark, sf).join(base, "part_id")
    assert V.prices(spark, sf, base=True).select(want.columns).exceptAll(want).count() == 0
    truth = made.join(base, "part_id").filter("truth != (claimed_c > actual_c AND actual_c >= base_c)")
    assert truth.count() == 0 < made.count() == read(spark, sf, "lineitem").count()
