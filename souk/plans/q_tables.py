"""Table-change queries. Each returns the new table state, so it is checked like any query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.exprs import FAKE_FLAG_SCORE, POSITIVE, cents, sentiment_of_rating
from souk.operators import campaigns as K
from souk.operators import prices as P
from souk.operators.series import top_k
from souk.plans.q_campaigns import TAGGED_SQL, WINDOWS_SQL
from souk.plans.q_prices import SCORED_CTES, TIE_SQL
from souk.plans.registry import register
from souk.session import scratch_path
from souk.sources import changes as C
from souk.sources import views as V
from souk.sources.versions import KeyedResults, VersionedTable, file_state, name_of

OUT_COLS = ["product", "seller", "date", *V.PRICE_TIE, "claimed_c", "actual_c"]
# Fixed parameters of the two rewrite jobs (one series; brands left untouched).
ONE_PRODUCT, ONE_SELLER = "Brand#1", "NATION_1"
SPARED = ("Brand#1", "Brand#2")


def _apply_rewrite(prices, hit_col, products):
    """Rewrite the hit rows to claimed = 2 x base price, actual = 1.05 x base price, in one pass."""
    base = products.select(F.col("id").alias("part_id"), "base_price", "base_c")
    hit = F.col(hit_col)
    return (prices.join(base, "part_id", "left")
                  .withColumns({"claimed_c": F.when(hit, F.col("base_c") * 2).otherwise(F.col("claimed_c")),
                                "actual_c": F.when(hit, cents(F.col("base_price") * 1.05)).otherwise(F.col("actual_c"))})
                  .select(*OUT_COLS))


REWRITE_SQL = f"""
    SELECT p.product, p.seller, p.date, p.order_key, p.line_no, p.part_id, p.supp_id,
           CASE WHEN h THEN c.base_c * 2 ELSE p.claimed_c END AS claimed_c,
           CASE WHEN h THEN CAST(round_even(c.base_price * CAST(1.05 AS DOUBLE) * 100, 0) AS BIGINT) ELSE p.actual_c END AS actual_c
    FROM hp p LEFT JOIN products c ON p.part_id = c.id"""


@register("src_12_rewrite_last5_dates", V.with_views(REWRITE_SQL, "prices", "products", extra={
    "t": f"""SELECT DISTINCT date FROM (SELECT date FROM prices WHERE product = '{ONE_PRODUCT}' AND seller = '{ONE_SELLER}'
             ORDER BY date DESC LIMIT 5)""",
    "hp": f"""SELECT *, (product = '{ONE_PRODUCT}' AND seller = '{ONE_SELLER}' AND date IN (SELECT date FROM t)) AS h
              FROM prices"""}))
def src_12_rewrite_last5_dates(spark, sf_dir):
    """SRC-12 + JOIN-02: rewrite the rows on the last 5 quote dates of one series
    (``date IN (SELECT ... ORDER BY date DESC LIMIT 5)``); returns the whole new table."""
    prices = V.prices(spark, sf_dir)
    series = prices.filter((F.col("product") == ONE_PRODUCT) & (F.col("seller") == ONE_SELLER))
    dates = series.orderBy(F.desc("date")).limit(5).select("date").distinct()   # at most 5 rows
    flagged = prices.join(F.broadcast(dates.withColumn("_in", F.lit(True))), "date", "left").withColumn(
        "_hit", (F.col("product") == ONE_PRODUCT) & (F.col("seller") == ONE_SELLER) & F.coalesce("_in", F.lit(False)))
    return _apply_rewrite(flagged, "_hit", V.products(spark, sf_dir))


SPARE_SQL = " AND ".join(f"NOT contains(product, '{b}')" for b in SPARED)


@register("src_13_rewrite_recent_all", V.with_views(REWRITE_SQL, "prices", "products", extra={
    "k": f"""SELECT DISTINCT product, seller, date FROM (
               SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC, order_key, line_no, part_id, supp_id) AS rn
               FROM prices WHERE {SPARE_SQL}) WHERE rn <= 5""",
    "hp": """SELECT p.*, k.product IS NOT NULL AS h FROM prices p
             LEFT JOIN k ON p.product = k.product AND p.seller = k.seller AND p.date = k.date"""}))
def src_13_rewrite_recent_all(spark, sf_dir):
    """SRC-13 + PRJ-08 + WIN-07: for every product except the spared brands, rewrite the
    (seller, date) cells of its 5 most recent quotes - one pass instead of a loop per product."""
    prices = V.prices(spark, sf_dir)
    keep = ~F.col("product").contains(SPARED[0]) & ~F.col("product").contains(SPARED[1])
    recent = top_k(prices.filter(keep), ["product"], [F.desc("date"), *[F.asc(c) for c in V.PRICE_TIE]], 5)
    cells = recent.select("product", "seller", "date").distinct().withColumn("_in", F.lit(True))
    flagged = prices.join(cells, ["product", "seller", "date"], "left").withColumn("_hit", F.coalesce("_in", F.lit(False)))
    return _apply_rewrite(flagged, "_hit", V.products(spark, sf_dir))


@register("src_09_keyed_update", V.with_views(f"""
    SELECT p.product, p.seller, {', '.join('p.' + c for c in ['date', *V.PRICE_TIE])},
           COALESCE(u.is_manipulation, false) AS is_manipulation, COALESCE(u.anomaly_score, CAST(0.0 AS DOUBLE)) AS anomaly_score
    FROM prices p LEFT JOIN (SELECT product, seller, {TIE_SQL}, true AS is_manipulation, CAST(0.85 AS DOUBLE) AS anomaly_score
                             FROM s WHERE is_manipulation) u
      USING (product, seller, date, order_key, line_no, part_id, supp_id)""", "prices", extra=SCORED_CTES))
def src_09_keyed_update(spark, sf_dir):
    """SRC-09 + JOIN-09: write the analysis flags back onto the price table by composite key."""
    prices = V.prices(spark, sf_dir).withColumn("is_manipulation", F.lit(False)).withColumn("anomaly_score", F.lit(0.0))
    keys = ["product", "seller", *P.ORDER]
    upd = (P.scored_quotes(spark, sf_dir).filter("is_manipulation")
             .select(*keys, F.lit(True).alias("is_manipulation"), F.lit(FAKE_FLAG_SCORE).alias("anomaly_score")))
    return C.keyed_update(prices, upd, keys, ["is_manipulation", "anomaly_score"]).select(
        *keys, "is_manipulation", "anomaly_score")


@register("src_09_update_by_day", V.with_views(f"""
    SELECT p.product, p.seller, {', '.join('p.' + c for c in ['date', *V.PRICE_TIE])}, u.is_manipulation,
           CASE WHEN u.is_manipulation THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS anomaly_score
    FROM prices p JOIN (SELECT product, seller, date, arg_max(is_manipulation, ({', '.join(V.PRICE_TIE)})) AS is_manipulation
                        FROM s GROUP BY product, seller, date) u USING (product, seller, date)""", "prices", extra=SCORED_CTES))
def src_09_update_by_day(spark, sf_dir):
    """SRC-09 + JOIN-09: flags written back by (product, date, seller); of a day's quotes the last wins."""
    prices = V.prices(spark, sf_dir).withColumns({"is_manipulation": F.lit(False), "anomaly_score": F.lit(0.0)})
    upd = P.scored_quotes(spark, sf_dir).withColumn("anomaly_score", F.when(F.col("is_manipulation"), FAKE_FLAG_SCORE).otherwise(0.0))
    out = C.keyed_update(prices, upd, ["product", "date", "seller"], ["is_manipulation", "anomaly_score"], V.PRICE_TIE)
    return out.select("product", "seller", *P.ORDER, "is_manipulation", "anomaly_score")


@register("src_10_update_by_id", V.with_views("""
    SELECT id, COALESCE(CASE WHEN review_rating IS NULL THEN 'Positive' WHEN review_rating <= 2 THEN 'Negative'
                              WHEN review_rating = 3 THEN 'Neutral' ELSE 'Positive' END, sentiment) AS sentiment_roberta
    FROM reviews""", "reviews"))
def src_10_update_by_id(spark, sf_dir):
    """SRC-10 (+ FN-03 with the Q2 policy): relabel one model column by id."""
    r = V.reviews(spark, sf_dir, with_text=False).withColumn("sentiment_roberta", F.col("sentiment"))
    upd = r.select("id", sentiment_of_rating("review_rating", null_as=POSITIVE).alias("sentiment_roberta"))
    return C.keyed_update(r, upd, ["id"], ["sentiment_roberta"]).select("id", "sentiment_roberta")


@register("src_11_conditional_rewrite", V.with_views("""
    SELECT id, name, CASE WHEN name ILIKE '%blue%' THEN 'img/blue.jpg' ELSE 'img/' || CAST(id AS VARCHAR) || '.jpg' END AS image_url
    FROM products""", "products"))
def src_11_conditional_rewrite(spark, sf_dir):
    """SRC-11: ``UPDATE products SET image_url = ... WHERE name LIKE '%blue%'``."""
    p = V.products(spark, sf_dir).withColumn("image_url", F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".jpg")))
    return C.rewrite_where(p, F.col("name").ilike("%blue%"), {"image_url": F.lit("img/blue.jpg")}).select(
        "id", "name", "image_url")


@register("src_08_insert_if_new", V.with_views("""
    SELECT name, id FROM (SELECT name, min(id) AS id FROM products WHERE category = 'ECONOMY' GROUP BY name)
    UNION ALL
    SELECT name, min(id) FROM products WHERE name NOT IN (SELECT name FROM products WHERE category = 'ECONOMY') GROUP BY name""",
    "products"))
def src_08_insert_if_new(spark, sf_dir):
    """SRC-08 + JOIN-03: insert catalogue names that are not present yet."""
    p = V.products(spark, sf_dir)
    old = p.filter(F.col("category") == "ECONOMY").groupBy("name").agg(F.min("id").alias("id"))
    new = p.groupBy("name").agg(F.min("id").alias("id"))
    return C.insert_if_absent(old, new, "name")


@register("src_15_cascade_delete", V.with_views("""
    SELECT product, seller, count(*) AS remaining FROM prices
    WHERE part_id NOT IN (SELECT id FROM products WHERE NOT is_active) GROUP BY product, seller""", "prices", "products"))
def src_15_cascade_delete(spark, sf_dir):
    """SRC-15: delete inactive products and cascade to their price rows."""
    p = V.products(spark, sf_dir)
    doomed = p.filter(~F.col("is_active")).select("id")
    left = C.cascade_delete({"prices": (V.prices(spark, sf_dir), "part_id")}, doomed, "id")["prices"]
    return left.groupBy("product", "seller").agg(F.count(F.lit(1)).alias("remaining"))


CHILDREN = ("prices", "anomalies", "campaign_quotes")


@register("src_15_child_tables", V.with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS child, part_id, order_key, line_no, supp_id, product, seller, date FROM {t} WHERE part_id IN (SELECT id FROM products WHERE is_active)"
    for n, t in zip(CHILDREN, ("prices", "(SELECT * FROM s WHERE is_manipulation)", "t"), strict=True)), "prices", "products",
    extra=dict(SCORED_CTES, cw=WINDOWS_SQL, t=TAGGED_SQL)))
def src_15_child_tables(spark, sf_dir):
    """SRC-15: delete inactive products; the new state of every child table keyed to a product (quotes,
    anomalies, campaign quotes), whole. Reviews carry a brand and no product id, so none can be keyed."""
    doomed = V.products(spark, sf_dir).filter(~F.col("is_active")).select("id")
    scored = P.scored_quotes(spark, sf_dir)
    tables = dict(zip(CHILDREN, (V.prices(spark, sf_dir), scored.filter("is_manipulation"), K.tag_campaigns(V.prices(spark, sf_dir))), strict=True))
    left = C.cascade_delete({n: (t.select("part_id", "order_key", "line_no", "supp_id", "product", "seller", "date"), "part_id") for n, t in tables.items()}, doomed, "id")
    return reduce(DataFrame.unionByName, [t.withColumn("child", F.lit(n)) for n, t in left.items()])


@register("src_16_referential_check", V.with_views("""
    SELECT product, count(*) FILTER (WHERE part_id IN (SELECT id FROM products WHERE is_active)) AS valid,
           count(*) FILTER (WHERE part_id NOT IN (SELECT id FROM products WHERE is_active)) AS orphans
    FROM prices GROUP BY product""", "prices", "products"))
def src_16_referential_check(spark, sf_dir):
    """SRC-16 + JOIN-02 + JOIN-03: rows whose parent (an active product) exists vs orphans."""
    prices = V.prices(spark, sf_dir)
    parent = V.products(spark, sf_dir).filter("is_active")
    checked = prices.join(parent.select(F.col("id").alias("_pk")).distinct(), F.col("part_id") == F.col("_pk"), "left")
    return checked.groupBy("product").agg(F.count("_pk").alias("valid"), F.count_if(F.col("_pk").isNull()).alias("orphans"))


@register("src_05_csv_roundtrip", V.with_views("""
    SELECT product, date, seller, order_key, line_no, part_id, supp_id,
           CAST(claimed_c AS DOUBLE) / 100 AS claimed_price, CAST(actual_c AS DOUBLE) / 100 AS actual_price
    FROM s WHERE is_manipulation""", "prices", extra=SCORED_CTES))
def src_05_csv_roundtrip(spark, sf_dir):
    """SRC-05 + SRC-07: write the anomaly list as CSV with a header, read it back typed."""
    rep = P.anomaly_report(P.scored_quotes(spark, sf_dir)).drop("confidence")
    path = C.write_table(rep, C.new_table_path(spark, "anomalies-csv"), fmt="csv", header="true")
    return spark.read.schema(rep.schema).option("header", "true").csv(path)


@register("src_06_append_partitioned", V.with_views("""
    SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS rows FROM prices GROUP BY 1""", "prices"))
def src_06_append_partitioned(spark, sf_dir):
    """SRC-06: append quotes in two batches to a month-partitioned table; read back."""
    prices = V.prices(spark, sf_dir).withColumn("month", F.trunc("date", "month"))
    path = C.new_table_path(spark, "prices-by-month")
    mid = F.lit("1998-01-01").cast("date")
    for batch in (prices.filter(F.col("date") < mid), prices.filter(F.col("date") >= mid)):
        # rebalance: few files a month, and a large month in several tasks
        C.write_table(batch.hint("rebalance", "month"), path, mode="append", partition_by=["month"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("month").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@register("src_07_truncate_reload", V.with_views("SELECT id, name, category, brand, base_c FROM products WHERE is_active", "products"))
def src_07_truncate_reload(spark, sf_dir):
    """SRC-07: a table that exists is emptied and loaded anew, in place: readers see the old content or
    the new, never a part. Here the whole catalogue is replaced by its active products."""
    table = VersionedTable(spark, scratch_path(spark, f"tables/catalogue-{name_of(sf_dir)}-{spark.sparkContext.applicationId}"))
    products = V.products(spark, sf_dir).select("id", "name", "category", "brand", "base_c", "is_active")
    if table.current() is None:
        table.overwrite(products)
    table.overwrite(products.filter("is_active").drop("is_active"))
    table.clean(keep=8)
    return table.read()


def stored_analysis(spark, sf_dir) -> KeyedResults:
    """The stored anomaly list of a folder's prices, brought up to its files."""
    store = KeyedResults(spark, scratch_path(spark, f"results/analysis-{name_of(sf_dir)}"), "product")

    def analyse(prices):
        return P.scored(prices, P.price_cuts(spark, sf_dir)).filter("is_manipulation").select("product", "seller", *V.PRICE_TIE, "date")

    store.refresh(file_state(spark, *P.price_tables(spark, sf_dir)), V.prices(spark, sf_dir), analyse)
    return store


@register("src_17_materialised_analysis", V.with_views("""
    SELECT product, seller, count(*) AS flagged FROM s WHERE is_manipulation AND product = 'Brand#7' GROUP BY product, seller""",
    "prices", extra=SCORED_CTES))
def src_17_materialised_analysis(spark, sf_dir):
    """SRC-17: the analysis is materialised once for every (product, seller) and reused while the price
    files are the same; changed files recompute the products whose quotes changed. A request for
    one product reads one partition."""
    store = stored_analysis(spark, sf_dir)
    return store.read("Brand#7").groupBy("product", "seller").agg(F.count(F.lit(1)).alias("flagged"))
