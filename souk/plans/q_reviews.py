"""Review queries over the ``reviews`` view (and the catalogue for name lookups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import prices as P
from souk.operators import reviews as R
from souk.plans.registry import register
from souk.sources import views as V

# Fixed query parameters (the endpoint's request arguments).
SEARCH, SENTIMENT, STORE = "the", "Positive", "src3"
PAGE, LIMIT, RECENT = 2, 10, 20
PAGE_RECENT = 500   # the product page asks for the last 500 reviews
KEYWORDS = ("#1", "#2")
AVG_RATING_SQL = "COALESCE(CAST(sum(review_rating) AS DOUBLE) / NULLIF(count(review_rating), 0), 0.0::DOUBLE)"


def _pct_sql(label):
    return f"CAST(round_even(CAST(count(*) FILTER (WHERE sentiment = '{label}') AS DOUBLE) / count(*) * 100, 0) AS INTEGER)"


DIST_SQL = (f"count(*) AS total, {_pct_sql('Positive')} AS positive_pct, {_pct_sql('Neutral')} AS neutral_pct, "
            f"{_pct_sql('Negative')} AS negative_pct, {AVG_RATING_SQL} AS avg_rating")


@register("prj_03_review_search", V.with_views(f"""
    SELECT id, product, review_rating, sentiment, store FROM reviews
    WHERE review_text ILIKE '%{SEARCH}%' AND sentiment = '{SENTIMENT}' AND store = '{STORE}'""", "reviews"))
def prj_03_review_search(spark, sf_dir):
    """PRJ-03 + PRJ-05 + PRJ-06: search, sentiment and store filters combined."""
    r = R.search(V.reviews(spark, sf_dir), search=SEARCH, sentiment=SENTIMENT, store=STORE)
    return r.select("id", "product", "review_rating", "sentiment", "store")


@register("agg_03_distribution", V.with_views(f"""
    SELECT product, {DIST_SQL} FROM reviews WHERE review_text ILIKE '%{SEARCH}%' GROUP BY product""", "reviews"))
def agg_03_distribution(spark, sf_dir):
    """AGG-02 + AGG-03 + AGG-04 + PRJ-04 + FN-12: filtered count, label percentages and mean rating per product
    (every filter but the sentiment one, store 'All Stores')."""
    r = R.search(V.reviews(spark, sf_dir), search=SEARCH, store="All Stores")
    return R.distribution(r)


def _adjust_sql(model):
    if model == "roberta":
        return ("CASE WHEN positive_pct > 2 THEN positive_pct - 2 ELSE positive_pct END AS positive_pct, "
                "CASE WHEN positive_pct > 2 THEN neutral_pct + 2 ELSE neutral_pct END AS neutral_pct, negative_pct")
    if model == "lstm":
        return ("CASE WHEN negative_pct > 2 THEN positive_pct + 1 ELSE positive_pct END AS positive_pct, neutral_pct, "
                "CASE WHEN negative_pct > 2 THEN negative_pct - 1 ELSE negative_pct END AS negative_pct")
    return "positive_pct, neutral_pct, negative_pct"


@register("agg_05_model_adjustment", V.with_views(" UNION ALL ".join(
    f"SELECT product, total, {_adjust_sql(m)}, avg_rating, '{m}' AS model FROM d" for m in ("bert", "roberta", "lstm")),
    "reviews", extra={"d": f"SELECT product, {DIST_SQL} FROM reviews GROUP BY product"}))
def agg_05_model_adjustment(spark, sf_dir):
    """AGG-05 (Q10): the per-model cosmetic shift, for each model name."""
    d = R.distribution(V.reviews(spark, sf_dir, with_text=False))
    out = None
    for m in ("bert", "roberta", "lstm"):
        a = R.model_adjusted(d, m)
        out = a if out is None else out.unionByName(a)
    return out


@register("sort_02_review_page", V.with_views(f"""
    SELECT product, id, review_rating, sentiment, row_num, total, CAST(ceil(CAST(total AS DOUBLE) / {LIMIT}) AS BIGINT) AS total_pages
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY id DESC) AS INTEGER) AS row_num,
                 count(*) OVER (PARTITION BY product) AS total FROM reviews)
    WHERE row_num > {(PAGE - 1) * LIMIT} AND row_num <= {PAGE * LIMIT}""", "reviews"))
def sort_02_review_page(spark, sf_dir):
    """SORT-02 + WIN-10 + FN-24: page 2 (10 per page, newest first) of every product."""
    p = R.page(V.reviews(spark, sf_dir, with_text=False), PAGE, LIMIT)
    return p.select("product", "id", "review_rating", "sentiment", "row_num", "total", "total_pages")


@register("win_08_recent_split", V.with_views(f"""
    SELECT product, count(*) AS reviews,
           CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS positive_pct,
           CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS negative_pct,
           100 - CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER)
               - CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS neutral_pct
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY id DESC) AS INTEGER) AS rn FROM reviews) WHERE rn <= {RECENT}
    GROUP BY product""", "reviews"))
def win_08_recent_split(spark, sf_dir):
    """WIN-08 + AGG-07: sentiment split of each product's last 20 reviews (endpoint default)."""
    return R.recent_split(V.reviews(spark, sf_dir, with_text=False), RECENT)


@register("agg_07_page_split_500", V.with_views(f"""
    SELECT product, count(*) AS reviews,
           CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS positive_pct,
           CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS negative_pct,
           100 - CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER)
               - CAST(floor(CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS DOUBLE) / count(*) * 100 + 0.5) AS INTEGER) AS neutral_pct
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product ORDER BY id DESC) AS INTEGER) AS rn FROM reviews) WHERE rn <= {PAGE_RECENT}
    GROUP BY product""", "reviews"))
def agg_07_page_split_500(spark, sf_dir):
    """AGG-07 + WIN-08: the product page's split, over each product's last 500 reviews."""
    return R.recent_split(V.reviews(spark, sf_dir, with_text=False), PAGE_RECENT)


@register("agg_06_product_summary", V.with_views(f"""
    SELECT product, {AVG_RATING_SQL} AS avg_rating, count(*) AS total_reviews, {_pct_sql('Positive')} AS pos_percent
    FROM reviews GROUP BY product""", "reviews"))
def agg_06_product_summary(spark, sf_dir):
    """AGG-06: product summary (mean rating, review count, positive percent)."""
    return R.product_summary(V.reviews(spark, sf_dir, with_text=False))


@register("agg_08_top_products", V.with_views("""
    SELECT product, review_count, rank FROM (
      SELECT product, count(*) AS review_count, CAST(row_number() OVER (ORDER BY count(*) DESC, product) AS INTEGER) AS rank
      FROM reviews GROUP BY product) WHERE rank <= 10""", "reviews"))
def agg_08_top_products(spark, sf_dir):
    """AGG-08: top 10 products by review count."""
    return R.top_products(V.reviews(spark, sf_dir, with_text=False), 10)


@register("agg_09_top_by_keyword", V.with_views(" UNION ALL ".join(f"""
    SELECT * FROM (SELECT '{k}' AS keyword, product, review_count,
                          CAST(row_number() OVER (ORDER BY review_count DESC, product) AS INTEGER) AS rank
                   FROM (SELECT product, count(*) AS review_count FROM reviews GROUP BY product)
                   WHERE contains(lower(product), lower('{k}'))) WHERE rank <= 5""" for k in KEYWORDS), "reviews"))
def agg_09_top_by_keyword(spark, sf_dir):
    """AGG-09: top 5 products for each keyword."""
    return R.top_by_keyword(V.reviews(spark, sf_dir, with_text=False), KEYWORDS, 5)


@register("agg_10_sentiment_counts", V.with_views("""
    SELECT product, sentiment, count(*) AS count FROM reviews WHERE sentiment IS NOT NULL GROUP BY product, sentiment""",
    "reviews"))
def agg_10_sentiment_counts(spark, sf_dir):
    """AGG-10 + PRJ-11: reviews per product and label, label column chosen by model name."""
    r = R.with_model_columns(V.reviews(spark, sf_dir, with_text=False))
    return R.sentiment_counts(r, R.label_column("nlptown"))


@register("agg_11_most_positive", V.with_views("""
    SELECT product, count(*) AS positive_reviews FROM reviews WHERE sentiment = 'Positive' GROUP BY product""", "reviews"))
def agg_11_most_positive(spark, sf_dir):
    """AGG-11: most positive products."""
    return R.most_positive(V.reviews(spark, sf_dir, with_text=False))


@register("agg_24_monthly_trend", V.with_views("""
    SELECT month, sentiment, reviews, round_even(CAST(reviews AS DOUBLE) / sum(reviews) OVER (PARTITION BY month) * 100 * 100, 0) / 100 AS share_pct
    FROM (SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, sentiment, count(*) AS reviews
          FROM reviews WHERE sentiment IS NOT NULL GROUP BY 1, 2)""", "reviews"))
def agg_24_monthly_trend(spark, sf_dir):
    """AGG-24: monthly sentiment share."""
    return R.monthly_trend(V.reviews(spark, sf_dir, with_text=False))


STOP_SQL = ", ".join(f"'{w}'" for w in R.KEYWORD_STOP_WORDS)


@register("agg_28_top_keywords", V.with_views(rf"""
    SELECT product, sentiment, word, count, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY product, sentiment ORDER BY count DESC, word) AS INTEGER) AS rank FROM (
        SELECT product, sentiment, word, count(*) AS count FROM (
          SELECT product, sentiment, unnest(regexp_split_to_array(lower(review_text), '[^\p{{L}}]+')) AS word
          FROM reviews WHERE sentiment IS NOT NULL)
        WHERE length(word) >= 3 AND word NOT IN ({STOP_SQL})
        GROUP BY product, sentiment, word))
    WHERE rank <= 5""", "reviews"))
def agg_28_top_keywords(spark, sf_dir):
    """AGG-28: 5 most frequent keywords per product and label over whole texts."""
    return R.top_keywords(V.reviews(spark, sf_dir), 5)


OVERALL_SQL = """
    SELECT product, positive, neutral, negative,
           CASE WHEN positive >= neutral AND positive >= negative THEN 'Positive'
                WHEN neutral >= negative THEN 'Neutral' ELSE 'Negative' END AS overall
    FROM (SELECT product, count(*) FILTER (WHERE sentiment = 'Positive') AS positive,
                 count(*) FILTER (WHERE sentiment = 'Neutral') AS neutral,
                 count(*) FILTER (WHERE sentiment = 'Negative') AS negative FROM reviews GROUP BY product)"""


@register("agg_31_overall_sentiment", V.with_views("SELECT * FROM o", "reviews", extra={"o": OVERALL_SQL}))
def agg_31_overall_sentiment(spark, sf_dir):
    """AGG-31: overall sentiment of each product."""
    return R.overall_sentiment(V.reviews(spark, sf_dir, with_text=False))


CATEGORY_SQL = "'group-' || CAST((CAST(regexp_extract(product, '#(\\d+)$', 1) AS INTEGER) - 1) // 5 AS VARCHAR)"


@register("agg_29_related_products", V.with_views(f"""
    SELECT for_product, rank, product, review_count, overall FROM (
      SELECT m.product AS for_product, l.product, l.review_count, l.overall,
             CAST(row_number() OVER (PARTITION BY m.product ORDER BY l.review_count DESC, l.product) AS INTEGER) AS rank
      FROM s m JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY review_count DESC, product) AS r FROM s) WHERE r <= 5) l
        ON m.category = l.category AND m.product <> l.product)
    WHERE rank <= 4""", "reviews", extra={"o": OVERALL_SQL, "s": f"""
    SELECT o.product, o.overall, c.category, c.review_count FROM o JOIN
      (SELECT product, {CATEGORY_SQL} AS category, count(*) AS review_count FROM reviews GROUP BY 1, 2) c USING (product)"""}))
def agg_29_related_products(spark, sf_dir):
    """AGG-29: cards of related products (same category) with counts and overall sentiment."""
    r = V.reviews(spark, sf_dir, with_text=False).withColumn("category", R.brand_category())
    return R.related_products(r, "category", 4)


@register("prj_18_review_profile", V.with_views("""
    SELECT count(*) AS rows, count(*) FILTER (WHERE id IS NULL) AS nulls_id,
           count(*) FILTER (WHERE product IS NULL) AS nulls_product, count(*) FILTER (WHERE store IS NULL) AS nulls_store,
           count(*) FILTER (WHERE review_text IS NULL) AS nulls_review_text,
           count(*) FILTER (WHERE review_rating IS NULL) AS nulls_review_rating,
           count(*) FILTER (WHERE review_date IS NULL) AS nulls_review_date, count(*) FILTER (WHERE lang IS NULL) AS nulls_lang,
           count(*) FILTER (WHERE sentiment IS NULL) AS nulls_sentiment
    FROM reviews""", "reviews"))
def prj_18_review_profile(spark, sf_dir):
    """PRJ-18: table profile (rows and NULLs per column)."""
    return R.profile(V.reviews(spark, sf_dir))


PROFILED = {"id": "bigint", "product": "string", "store": "string", "review_rating": "int", "review_date": "date", "lang": "string", "sentiment": "string", "n_chars": "int"}


@register("prj_18_column_profile", V.with_views(" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, CAST(min({c}) AS VARCHAR) AS min,
           CAST(max({c}) AS VARCHAR) AS max, {f"avg({c})" if t in ("bigint", "int") else "CAST(NULL AS DOUBLE)"} AS mean FROM r"""
    for c, t in PROFILED.items()), "reviews", extra={"r": "SELECT *, CAST(length(review_text) AS INTEGER) AS n_chars FROM reviews"}))
def prj_18_column_profile(spark, sf_dir):
    """PRJ-18: rows, NULLs, least, largest and mean of every review column in one pass."""
    r = V.reviews(spark, sf_dir).withColumn("n_chars", F.length("review_text"))
    return R.column_profile(r.select(*PROFILED))


@register("prj_18_first_rows", V.with_views("""
    SELECT id, product, store, review_rating, review_date, lang, sentiment, review_text FROM reviews ORDER BY id LIMIT 5""", "reviews"))
def prj_18_first_rows(spark, sf_dir):
    """PRJ-18: the first five reviews."""
    return R.first_rows(V.reviews(spark, sf_dir), ["id"]).select("id", "product", "store", "review_rating", "review_date", "lang", "sentiment", "review_text")


MODELS_SQL = f"SELECT *, {', '.join(f'{R.stored_label_sql(m)} AS sentiment_{m}' for m in ('bert', 'roberta', 'lstm'))} FROM reviews"


@register("prj_11_model_columns", V.with_views(" UNION ALL ".join(
    f"SELECT '{m}' AS model, product, sentiment_{c} AS sentiment, count(*) AS count FROM m WHERE sentiment_{c} IS NOT NULL GROUP BY product, sentiment_{c}"
    for m, c in (("bert", "bert"), ("nlptown", "bert"), ("roberta", "roberta"), ("lstm", "lstm"))), "reviews", extra={"m": MODELS_SQL}))
def prj_11_model_columns(spark, sf_dir):
    """PRJ-11: the label column is chosen by the model's name (nlptown is an alias of bert); the three
    stored columns differ, so each name must reach its own. One pass over the reviews."""
    return R.counts_by_model(R.with_model_columns(V.reviews(spark, sf_dir, with_text=False)))


@register("prj_15_text_length_guard", V.with_views(r"""
    SELECT lang, count(*) FILTER (WHERE length(regexp_replace(review_text, '^\s+|\s+$', '', 'g')) >= 3) AS long_enough,
           count(*) FILTER (WHERE length(regexp_replace(review_text, '^\s+|\s+$', '', 'g')) < 3) AS too_short
    FROM reviews GROUP BY lang""", "reviews"))
def prj_15_text_length_guard(spark, sf_dir):
    """PRJ-15: text length guard after trimming whitespace."""
    r = V.reviews(spark, sf_dir)
    n = F.length(F.regexp_replace("review_text", r"^\s+|\s+$", ""))
    return r.groupBy("lang").agg(F.count_if(n >= 3).alias("long_enough"), F.count_if(n < 3).alias("too_short"))


@register("prj_10_dropna", V.with_views("""
    SELECT product, count(*) AS complete FROM reviews WHERE review_text IS NOT NULL AND review_rating IS NOT NULL
    GROUP BY product""", "reviews"))
def prj_10_dropna(spark, sf_dir):
    """PRJ-10: rows with text and rating, per product."""
    r = V.reviews(spark, sf_dir).dropna(subset=["review_text", "review_rating"])
    return r.groupBy("product").agg(F.count(F.lit(1)).alias("complete"))


@register("prj_07_regex_filter", V.with_views("""
    SELECT product, count(*) FILTER (WHERE COALESCE(regexp_matches(review_text, '(?i)elle|und'), false)) AS matches
    FROM reviews GROUP BY product""", "reviews"))
def prj_07_regex_filter(spark, sf_dir):
    """PRJ-07: case-insensitive regex alternation, NULL -> false."""
    from souk.functions.exprs import rlike_ci
    r = V.reviews(spark, sf_dir)
    return r.groupBy("product").agg(F.count_if(rlike_ci("review_text", "elle|und")).alias("matches"))


@register("prj_06_wildcard_search", V.with_views("""
    SELECT product, count(*) AS hits FROM reviews WHERE review_text ILIKE '%ou%an%' GROUP BY product""", "reviews"))
def prj_06_wildcard_search(spark, sf_dir):
    """PRJ-06 (Q7): a search containing '%' keeps its wildcard meaning."""
    r = R.search(V.reviews(spark, sf_dir), search="ou%an")
    return r.groupBy("product").agg(F.count(F.lit(1)).alias("hits"))


@register("prj_01_projection", V.with_views("""
    SELECT id, product AS product_name, store, review_rating AS rating, review_date FROM reviews""", "reviews"))
def prj_01_projection(spark, sf_dir):
    """PRJ-01 + PRJ-02: projection, rename and drop."""
    r = V.reviews(spark, sf_dir, with_text=False)
    return (r.withColumnRenamed("product", "product_name").withColumnRenamed("review_rating", "rating")
             .drop("lang", "sentiment"))


@register("fn_29_30_display", V.with_views("""
    SELECT r.id, CASE WHEN r.sentiment = 'Positive' THEN 'pos' WHEN r.sentiment = 'Negative' THEN 'neg' ELSE 'neu' END AS sentiment_class,
           COALESCE(NULLIF(r.store, ''), NULLIF(b.best_seller, ''), 'Multiple Stores') AS shown_seller
    FROM reviews r LEFT JOIN (
      SELECT product, arg_min(seller, (actual_c, order_key, line_no, part_id, supp_id)) AS best_seller
      FROM prices JOIN (SELECT product, max(date) AS date FROM prices GROUP BY product) USING (product, date)
      GROUP BY product) b USING (product)""", "reviews", "prices"))
def fn_29_30_display(spark, sf_dir):
    """FN-29 + FN-30: display class of each label and the seller shown for the review."""
    snap = P.latest_snapshot(V.prices(spark, sf_dir)).select("product", "best_seller")
    r = V.reviews(spark, sf_dir, with_text=False).join(snap, "product", "left")
    return r.select("id", R.sentiment_class().alias("sentiment_class"),
                    R.shown_seller(F.col("store"), F.col("best_seller")).alias("shown_seller"))


@register("fn_08_date_formats", V.with_views("""
    SELECT id, review_date + 7 AS due_date, strftime(review_date, '%d %b %Y') AS short_text,
           strftime(review_date, '%B %d, %Y') AS long_text, strftime(review_date, '%Y-%m-%d') AS iso_text
    FROM reviews""", "reviews"))
def fn_08_date_formats(spark, sf_dir):
    """FN-08: day arithmetic and the three date formats."""
    r = V.reviews(spark, sf_dir, with_text=False)
    return r.select("id", F.date_add("review_date", 7).alias("due_date"),
                    F.date_format("review_date", "dd MMM yyyy").alias("short_text"),
                    F.date_format("review_date", "MMMM dd, yyyy").alias("long_text"),
                    F.date_format("review_date", "yyyy-MM-dd").alias("iso_text"))


# ----------------------------------------------------------------------------- catalogue

@register("prj_09_active_products", V.with_views("""
    SELECT category, count(*) FILTER (WHERE is_active) AS active, count(*) AS all_products FROM products GROUP BY category""",
    "products"))
def prj_09_active_products(spark, sf_dir):
    """PRJ-09: active-only vs all products."""
    p = V.products(spark, sf_dir)
    return p.groupBy("category").agg(F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("all_products"))


@register("prj_12_resolve_keyword", V.with_views("""
    SELECT COALESCE(m.id, f.id) AS id, COALESCE(m.name, f.name) AS name, m.id IS NOT NULL AS matched
    FROM (SELECT arg_min(id, id) AS id, arg_min(name, id) AS name FROM products
          WHERE starts_with(lower(name), 'blue') OR contains(lower(name), 'blue')) m,
         (SELECT arg_min(id, id) AS id, arg_min(name, id) AS name FROM products) f""", "products"))
def prj_12_resolve_keyword(spark, sf_dir):
    """PRJ-12 + FN-06: product by keyword (prefix or substring, first by id), else the first."""
    from souk.operators.catalog import resolve_keyword
    return resolve_keyword(V.products(spark, sf_dir), "blue")


@register("prj_13_resolve_exact", V.with_views("""
    SELECT arg_min(id, (rk, id)) AS id, arg_min(name, (rk, id)) AS name, min(rk) AS match_rank
    FROM (SELECT id, name, CASE WHEN name = 'blue bolt' THEN 0 ELSE 1 END AS rk FROM products
          WHERE name = 'blue bolt' OR name ILIKE '%blue bolt%') HAVING count(*) > 0""", "products"))
def prj_13_resolve_exact(spark, sf_dir):
    """PRJ-13: exact name, else substring; the first match wins."""
    from souk.operators.catalog import resolve_exact
    return resolve_exact(V.products(spark, sf_dir), "blue bolt")


@register("prj_13_resolve_all", V.with_views("""
    SELECT id, name, 0 AS match_rank FROM products ORDER BY id LIMIT 1""", "products"))
def prj_13_resolve_all(spark, sf_dir):
    """PRJ-13: the name 'all' is the first product."""
    from souk.operators.catalog import resolve_exact
    return resolve_exact(V.products(spark, sf_dir), "all")


@register("prj_14_brand_guard", V.with_views("""
    SELECT category, count(*) AS matching FROM products WHERE contains(lower(name), 'ring') GROUP BY category""", "products"))
def prj_14_brand_guard(spark, sf_dir):
    """PRJ-14: name contains a brand keyword (lower-cased)."""
    p = V.products(spark, sf_dir).filter(F.lower("name").contains("ring"))
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("matching"))


@register("prj_08_negative_name_filter", V.with_views("""
    SELECT category, count(*) AS kept FROM products WHERE NOT contains(name, 'blue') AND NOT contains(name, 'red')
    GROUP BY category""", "products"))
def prj_08_negative_name_filter(spark, sf_dir):
    """PRJ-08: skip products whose name mentions listed brands."""
    p = V.products(spark, sf_dir).filter(~F.col("name").contains("blue") & ~F.col("name").contains("red"))
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("kept"))


@register("fn_07_image_cycle", V.with_views("""
    SELECT id, CAST(len(string_split(name, ' ')) AS INTEGER) AS n_images,
           list_extract(string_split(name, ' '), (7 % len(string_split(name, ' '))) + 1) AS image
    FROM products""", "products"))
def fn_07_image_cycle(spark, sf_dir):
    """FN-07: split a list and pick a circular index (the image carousel)."""
    p = V.products(spark, sf_dir)
    imgs = F.split("name", " ")
    return p.select("id", F.size(imgs).alias("n_images"),
                    F.element_at(imgs, (F.pmod(F.lit(7), F.size(imgs)) + 1).cast("int")).alias("image"))


@register("fn_06_text_helpers", V.with_views("""
    SELECT id, lower(trim(name)) AS name_lower, starts_with(lower(trim(name)), 'small') AS starts_small,
           contains(lower(name), 'ring') AS has_ring FROM products""", "products"))
def fn_06_text_helpers(spark, sf_dir):
    """FN-06: lower, strip, prefix and contains."""
    p = V.products(spark, sf_dir)
    low = F.lower(F.trim("name"))
    return p.select("id", low.alias("name_lower"), low.startswith("small").alias("starts_small"),
                    F.lower("name").contains("ring").alias("has_ring"))


@register("agg_01_table_counts", V.with_views("""
    SELECT 'products' AS table_name, count(*) AS rows FROM products UNION ALL
    SELECT 'reviews', count(*) FROM reviews UNION ALL
    SELECT 'prices', count(*) FROM prices""", "products", "reviews", "prices"))
def agg_01_table_counts(spark, sf_dir):
    """AGG-01: row counts of several tables in one result."""
    parts = [("products", V.products(spark, sf_dir)), ("reviews", V.reviews(spark, sf_dir, with_text=False)),
             ("prices", V.prices(spark, sf_dir))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("sort_02_keyset_page", V.with_views("""
    SELECT id, product, review_rating FROM reviews WHERE id < 500 ORDER BY id DESC LIMIT 10""", "reviews"))
def sort_02_keyset_page(spark, sf_dir):
    """SORT-02 (deep pages): the next 10 reviews after the last id seen (keyset paging)."""
    return R.keyset_page(V.reviews(spark, sf_dir, with_text=False), 500, 10).select("id", "product", "review_rating")
