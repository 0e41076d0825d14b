"""Ingest queries: the review and price files written in the reference's CSV layouts from the
stand-in tables, read back through the ingest path and normalised."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.exprs import money
from souk.operators import prices as P
from souk.plans.q_prices import SCORED_CTES
from souk.plans.registry import register
from souk.sources import changes as C
from souk.sources import ingest as I
from souk.sources import views as V
from souk.sources.tables import read


def review_csv_layout(reviews):
    """Reviews in the reference file layout, using the textual variants it meets in the wild
    (plain and '5.0 out of 5 stars' ratings, both date styles, empty helpful counts)."""
    i = F.col("id")
    rating = (F.when(F.col("review_rating").isNull(), F.lit(""))
               .when(i % 3 == 0, F.concat(F.col("review_rating").cast("string"), F.lit(".0 out of 5 stars")))
               .otherwise(F.col("review_rating").cast("string")))
    verified = F.when(i % 3 == 0, F.lit("TRUE")).when(i % 3 == 1, F.lit("Verified Purchase")).otherwise(F.lit("FALSE"))
    date = F.concat(F.lit(I.DATE_PREFIX), F.when(i % 2 == 0, F.date_format("review_date", "dd MMM yyyy"))
                    .otherwise(F.date_format("review_date", "MMMM dd, yyyy")))
    helpful = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat((i % 97 + 1).cast("string"), F.lit(" people found this helpful")))
    return reviews.select(
        F.concat(F.lit("https://shop.invalid/dp/"), F.col("product")).alias("url"),
        F.col("product").alias("product_name"), F.concat(F.lit("Customer_"), i.cast("string")).alias("reviewer_name"),
        F.col("store").alias("review_title"), "review_text", rating.alias("review_rating"),
        verified.alias("verified_purchase"), date.alias("review_date"), helpful.alias("helpful_count"),
        F.concat(F.lit("id-"), i.cast("string")).alias("uniq_id"), F.lit("24/10/23 10:00").alias("scraped_at"))


@register("src_01_review_csv_roundtrip", V.with_views("""
    SELECT id, CASE WHEN review_rating IS NULL OR id % 3 = 0 THEN 4 ELSE review_rating END AS rating,
           id % 3 IN (0, 1) AS verified, review_date AS date,
           CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(id % 97 + 1 AS INTEGER) END AS helpful,
           CAST(length(review_text) AS BIGINT) AS n_chars
    FROM reviews""", "reviews"))
def src_01_review_csv_roundtrip(spark, sf_dir):
    """SRC-01 + SRC-05 + FN-01 + FN-02 + FN-09 + FN-10 + FN-11: write review CSV, read it
    back with the fixed schema (quoted commas, line breaks), normalise every field."""
    layout = review_csv_layout(V.reviews(spark, sf_dir))
    path = C.write_table(layout, C.new_table_path(spark, "reviews-csv"), fmt="csv", **I.CSV_OPTIONS)
    back = I.normalise_reviews(I.read_reviews(spark, path), rating_policy="four")
    return back.select(F.regexp_extract("uniq_id", r"^id-(\d+)$", 1).cast("bigint").alias("id"),
                       "rating", "verified", "date", "helpful", F.length("review_text").cast("bigint").alias("n_chars"))


@register("src_02_price_csv_roundtrip", V.with_views("""
    SELECT product, count(*) FILTER (WHERE truth AND is_manipulation) AS tp,
           count(*) FILTER (WHERE NOT truth AND is_manipulation) AS fp,
           count(*) FILTER (WHERE truth AND NOT is_manipulation) AS fn,
           count(*) FILTER (WHERE NOT truth AND NOT is_manipulation) AS tn
    FROM (SELECT s.product, s.is_manipulation, (s.claimed_c > s.actual_c AND s.actual_c >= c.base_c) AS truth
          FROM s JOIN products c ON s.part_id = c.id)
    GROUP BY product""", "prices", "products", extra=SCORED_CTES))
def src_02_price_csv_roundtrip(spark, sf_dir):
    """SRC-02 + FN-27 + FN-25: price history written in the reference CSV layout (true list
    price = the part's retail price), read back typed, rule flags scored against truth."""
    s = P.scored_quotes(spark, sf_dir)
    base = V.products(spark, sf_dir).select(F.col("id").alias("part_id"), "base_price")
    layout = s.join(base, "part_id").select(
        "date", F.col("product").alias("product_name"), "seller", money("actual_c").alias("actual_price"),
        money("claimed_c").alias("claimed_original_price"), "is_manipulation", F.col("base_price").alias("real_old_price"))
    path = C.write_table(layout, C.new_table_path(spark, "prices-csv"), fmt="csv", header="true")
    back = I.read_prices(spark, path).withColumn("truth", I.truth_label())
    t, m = F.col("truth"), F.col("is_manipulation")
    return back.groupBy(F.col("product_name").alias("product")).agg(
        F.count_if(t & m).alias("tp"), F.count_if(~t & m).alias("fp"), F.count_if(t & ~m).alias("fn"),
        F.count_if(~t & ~m).alias("tn"))


@register("set_01_union_sources", V.with_views("""
    SELECT kind, count(*) AS rows, count(product) AS with_product FROM (
      SELECT 'documents' AS kind, product FROM reviews
      UNION ALL SELECT 'conversations', NULL FROM conversations)
    GROUP BY kind""", "reviews"))
def set_01_union_sources(spark, sf_dir):
    """SET-01: reviews from two sources with different columns in one table."""
    a = V.reviews(spark, sf_dir, with_text=False).select("id", "product", F.lit("documents").alias("kind"))
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    b = conv.select(F.col("conv_id").alias("id"), F.col("text").alias("review_text"), F.lit("conversations").alias("kind"))
    u = I.union_sources([a, b])
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count("product").alias("with_product"))


@register("set_01_union_rows", V.with_views("""
    SELECT 'documents' AS kind, id, product, store, sentiment, NULL::BIGINT AS turn, NULL AS role, md5(review_text) AS text_md5 FROM reviews
    UNION ALL SELECT 'conversations', conv_id, NULL, NULL, NULL, turn, role, md5(text) FROM conversations""", "reviews"))
def set_01_union_rows(spark, sf_dir):
    """SET-01: the union itself: every row of two sources in one table, columns that a source lacks NULL."""
    a = V.reviews(spark, sf_dir).select(F.lit("documents").alias("kind"), "id", "product", "store", "sentiment", F.md5("review_text").alias("text_md5"))
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    b = conv.select(F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), "turn", "role", F.md5("text").alias("text_md5"))
    return I.union_sources([a, b])


@register("join_04_name_lookup", V.with_views("""
    SELECT p.date, p.seller, p.order_key, p.line_no, p.supp_id, c.name AS product_name, d.product_id
    FROM prices p JOIN products c ON p.part_id = c.id
    JOIN (SELECT name, min(id) AS product_id FROM products WHERE is_active AND NOT contains(name, 'blue') GROUP BY name) d ON d.name = c.name""", "prices", "products"))
def join_04_name_lookup(spark, sf_dir):
    """JOIN-04: loaded price rows know their product by name only; a catalogue gives each name one id, and
    rows whose name is not in it are skipped (here it lacks the names with "blue" and what is inactive)."""
    catalogue = V.products(spark, sf_dir)
    loaded = P.with_product_names(V.prices(spark, sf_dir), catalogue).select(
        "date", "seller", "order_key", "line_no", "supp_id", F.col("name").alias("product_name"))
    return C.lookup_ids(loaded, catalogue.filter(F.col("is_active") & ~F.col("name").contains("blue")).select("id", "name"), "product_name", "product_id")


@register("set_02_split_cap_union", V.with_views("""
    SELECT 'one' AS brand, id FROM reviews WHERE regexp_matches(product, '(?i)brand#1$')
    UNION ALL SELECT 'two', id FROM reviews WHERE regexp_matches(product, '(?i)brand#2$')""", "reviews"))
def set_02_split_cap_union(spark, sf_dir):
    """SET-02: split one source into two brands, whole, and union them."""
    r = V.reviews(spark, sf_dir, with_text=False)
    out = I.split_brands_capped(r, {"one": "brand#1$", "two": "brand#2$"}, "product", [F.asc("id")])
    return out.select("brand", "id")
