from pyspark.sql import functions as F

from souk import api
from souk.plans.registry import load_all


def test_analyze_price_matches_whole_table(spark, sf):
    out = api.analyze_price(spark, sf, "Brand#3")
    whole = load_all()["prj_19_anomaly_report"].build(spark, sf).filter(F.col("product") == "Brand#3")
    assert out["anomalies"].count() == whole.count()
    assert out["stats"].count() == 1 and out["commentary"].count() == 1


def test_store_filter_is_per_seller(spark, sf):
    one = api.analyze_price(spark, sf, "Brand#3", store="NATION_3")["anomalies"]
    whole = api.analyze_price(spark, sf, "Brand#3")["anomalies"].filter(F.col("seller") == "NATION_3")
    assert one.exceptAll(whole).count() == 0 and whole.exceptAll(one).count() == 0
    assert api.analyze_price(spark, sf, "Brand#3", store="All Stores")["anomalies"].count() >= one.count()


def test_reviews_page_and_deals(spark, sf):
    r = api.reviews_page(spark, sf, "Brand#1", page=1, limit=5, model_type="nlptown")
    assert r["page"].count() <= 5
    assert r["distribution"].count() == 1
    beyond = api.reviews_page(spark, sf, "Brand#1", page=999, limit=5)
    assert beyond["page"].count() == 0
    d = api.campaign_deals(spark, sf, "Brand#2")
    assert d["stats"].count() == 1 and d["deals"].count() >= 1
    assert api.find_product(spark, sf, keyword="blue").count() == 1


def test_stored_anomalies_equal_the_analysis(spark, sf):
    whole = {tuple(r) for r in api.analyze_price(spark, sf, "Brand#7")["anomalies"].select("seller", "date", "order_key", "line_no").collect()}
    for store in (None, "NATION_3"):
        got = [tuple(r) for r in api.stored_anomalies(spark, sf, "Brand#7", store).select("seller", "date", "order_key", "line_no").collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in whole if store in (None, r[0])}
