"""Price-series queries over the ``prices`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import prices as P
from souk.plans.registry import register
from souk.sources import views as V

TIE_SQL = "date, order_key, line_no, part_id, supp_id"
ROLL7 = f"""
    SELECT *, SUM(actual_c) OVER w AS roll_sum_c, COUNT(*) OVER w AS roll_n
    FROM prices
    WINDOW w AS (PARTITION BY product, seller ORDER BY {TIE_SQL} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@register("fake_discounts", V.with_views("""
    SELECT product, seller, date, order_key, line_no, part_id, supp_id,
           CAST(actual_c AS DOUBLE) / 100 AS actual_price,
           CAST(claimed_c AS DOUBLE) / 100 AS claimed_price,
           CAST(claimed_c - actual_c AS DOUBLE) / 100 AS discount_claim,
           CAST(roll_sum_c AS DOUBLE) / roll_n / 100 AS rolling_avg,
           CAST(0.85 AS DOUBLE) AS anomaly_score
    FROM r
    WHERE claimed_c > actual_c AND actual_c * 10 * roll_n >= roll_sum_c * 9""",
    "prices", extra={"r": ROLL7}))
def fake_discounts(spark, sf_dir):
    """FN-14 over WIN-01: quotes whose claimed list price exceeds the selling price while the
    selling price is at least 90% of its 7-row rolling mean (per product and seller)."""
    return P.fake_discounts(_scored(spark, sf_dir))


SCORED = f"""
    SELECT *, (claimed_c > actual_c AND actual_c * 10 * roll_n >= roll_sum_c * 9) AS is_manipulation
    FROM r"""
SCORED_CTES = {"r": ROLL7, "s": SCORED}


def _scored(spark, sf_dir):
    return P.scored_quotes(spark, sf_dir)


@register("win_01_rolling_mean", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, CAST(actual_c AS DOUBLE) / 100 AS actual_price,
           CAST(roll_sum_c AS DOUBLE) / roll_n / 100 AS rolling_avg, roll_n
    FROM r""", "prices", extra={"r": ROLL7}))
def win_01_rolling_mean(spark, sf_dir):
    """WIN-01/WIN-02/WIN-11: 7-row rolling mean (min 1 row) of every series, every quote."""
    return P.with_rolling_mean(V.prices(spark, sf_dir).drop("claimed_c"), cuts=P.price_cuts(spark, sf_dir)).select(
        "product", "seller", *P.ORDER, (F.col("actual_c").cast("double") / 100).alias("actual_price"),
        F.coalesce("rolling_avg", F.col("actual_c").cast("double") / 100).alias("rolling_avg"), "roll_n")


@register("win_03_rolling14_rule", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, CAST(s14 AS DOUBLE) / n14 / 100 AS rolling_avg_14,
           (claimed_c > actual_c AND actual_c * 10 * n14 >= s14 * 9) AS rule_flag
    FROM (SELECT *, SUM(actual_c) OVER w AS s14, COUNT(*) OVER w AS n14 FROM prices
          WINDOW w AS (PARTITION BY product ORDER BY {TIE_SQL} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""",
    "prices"))
def win_03_rolling14_rule(spark, sf_dir):
    """WIN-03 + FN-15 rule part: 14-row rolling mean per product, confirming rule."""
    return P.rolling_mean_long(V.prices(spark, sf_dir), P.price_cuts(spark, sf_dir, ["product"])).select(
        "product", "seller", *P.ORDER, "rolling_avg_14", "rule_flag")


@register("fn_13_discounts", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, CAST(claimed_c - actual_c AS DOUBLE) / 100 AS discount_amount,
           round_even(COALESCE(CAST(claimed_c - actual_c AS DOUBLE) / NULLIF(CAST(claimed_c AS DOUBLE), 0) * 100, 0) * 10, 0) / 10
             AS discount_pct
    FROM prices""", "prices"))
def fn_13_discounts(spark, sf_dir):
    """FN-13 (+FN-12): discount amount and percent of every quote."""
    return P.discounts(V.prices(spark, sf_dir))


CONF_SQL = ("round_even((CAST(88.5 AS DOUBLE) + CAST(list_sum(list_transform(string_split(strftime(date, '%Y-%m-%d') || seller, ''), "
            "lambda ch: unicode(ch))) % 110 AS DOUBLE) / 10) * 10, 0) / 10")


@register("prj_19_anomaly_report", V.with_views(f"""
    SELECT product, date, seller, order_key, line_no, part_id, supp_id,
           CAST(claimed_c AS DOUBLE) / 100 AS claimed_price, CAST(actual_c AS DOUBLE) / 100 AS actual_price,
           {CONF_SQL} AS confidence
    FROM s WHERE is_manipulation""", "prices", extra=SCORED_CTES))
def prj_19_anomaly_report(spark, sf_dir):
    """PRJ-19 + FN-19: flagged quotes with claimed, actual and the checksum confidence."""
    return P.anomaly_report(_scored(spark, sf_dir))


@register("agg_12_latest_snapshot", V.with_views("""
    SELECT product, date AS latest_date,
           arg_min(seller, (actual_c, order_key, line_no, part_id, supp_id)) AS best_seller,
           CAST(min(actual_c) AS DOUBLE) / 100 AS best_price,
           round_even(CAST(sum(actual_c) AS DOUBLE) / count(*) / 100 * 100, 0) / 100 AS avg_price,
           round_even(COALESCE(CAST(arg_min(claimed_c - actual_c, (actual_c, order_key, line_no, part_id, supp_id)) AS DOUBLE)
               / NULLIF(CAST(arg_min(claimed_c, (actual_c, order_key, line_no, part_id, supp_id)) AS DOUBLE), 0) * 100, 0) * 10, 0) / 10
             AS discount_pct,
           count(*) AS quotes
    FROM prices JOIN (SELECT product, max(date) AS date FROM prices GROUP BY product) USING (product, date)
    GROUP BY product, date""", "prices"))
def agg_12_latest_snapshot(spark, sf_dir):
    """WIN-06 + AGG-12: latest-date snapshot per product: best price/seller, mean, discount."""
    return P.latest_snapshot(V.prices(spark, sf_dir))


@register("agg_13_flag_summary", V.with_views("""
    SELECT product, bool_or(is_manipulation) AS is_manipulated,
           arg_max(seller, (date, order_key, line_no, part_id, supp_id)) FILTER (WHERE is_manipulation) AS manip_seller,
           CAST(count(*) FILTER (WHERE is_manipulation) AS BIGINT) AS flagged
    FROM s GROUP BY product""", "prices", extra=SCORED_CTES))
def agg_13_flag_summary(spark, sf_dir):
    """AGG-13: any flag per product and the seller of the last flagged quote."""
    return P.flag_summary(_scored(spark, sf_dir))


@register("agg_14_dates_sellers", V.with_views("""
    SELECT product, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date,
           array_to_string(list_sort(list_distinct(list(seller))), ',') AS sellers,
           count(DISTINCT seller) AS n_sellers
    FROM prices GROUP BY product""", "prices"))
def agg_14_dates_sellers(spark, sf_dir):
    """AGG-14 + SET-03: sorted distinct dates and sellers per product."""
    return P.dates_and_sellers(V.prices(spark, sf_dir))


CELLS = """
    SELECT product, seller, date, count(*) AS n_quotes,
           arg_min(actual_c, (order_key, line_no, part_id, supp_id)) AS first_c,
           arg_max(actual_c, (order_key, line_no, part_id, supp_id)) AS last_c
    FROM prices GROUP BY product, seller, date"""
GRID = """
    SELECT d.product, s.seller, d.date, c.first_c, c.last_c
    FROM (SELECT DISTINCT product, date FROM prices) d
    JOIN (SELECT DISTINCT product, seller FROM prices) s ON d.product = s.product
    LEFT JOIN cells c ON c.product = d.product AND c.seller = s.seller AND c.date = d.date"""


@register("win_09_first_last_quote", V.with_views("""
    SELECT product, seller, date, n_quotes, CAST(first_c AS DOUBLE) / 100 AS first_price,
           CAST(last_c AS DOUBLE) / 100 AS last_price FROM cells""", "prices", extra={"cells": CELLS}))
def win_09_first_last_quote(spark, sf_dir):
    """WIN-09 (quirk Q11): first and last quote of every (product, seller, day)."""
    c = P.cell_quotes(V.prices(spark, sf_dir))
    return c.select("product", "seller", "date", "n_quotes",
                    (F.col("first_c").cast("double") / 100).alias("first_price"),
                    (F.col("last_c").cast("double") / 100).alias("last_price"))


@register("join_07_grid_summary", V.with_views("""
    SELECT product, seller, count(*) AS grid_days, count(first_c) AS quoted_days,
           count(*) - count(first_c) AS empty_cells, CAST(sum(first_c) AS BIGINT) AS sum_first_c
    FROM grid GROUP BY product, seller""", "prices", extra={"cells": CELLS, "grid": GRID}))
def join_07_grid_summary(spark, sf_dir):
    """JOIN-06 + JOIN-07: date x seller spine per product, quotes left-aligned onto it."""
    return P.grid_summary(V.prices(spark, sf_dir))


@register("join_08_forward_fill", V.with_views("""
    SELECT product, seller, count(filled_c) AS filled_cells, count(*) - count(filled_c) AS leading_nulls,
           CAST(sum(filled_c) AS BIGINT) AS sum_filled_c, CAST(arg_max(filled_c, date) AS DOUBLE) / 100 AS last_price
    FROM (SELECT *, last_value(last_c IGNORE NULLS) OVER (PARTITION BY product, seller ORDER BY date
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_c FROM grid)
    GROUP BY product, seller""", "prices", extra={"cells": CELLS, "grid": GRID}))
def join_08_forward_fill(spark, sf_dir):
    """JOIN-08 + WIN-05: as-of alignment, last known price carried forward on the spine."""
    return P.fill_summary(V.prices(spark, sf_dir))


# The nation dimension has 25 rows by schema; its names are the pivot's columns.
PIVOT_SELLERS = [f"NATION_{i}" for i in range(25)]


@register("agg_15_pivot", V.with_views("SELECT product, date, " + ", ".join(
    f"max(CAST(first_c AS DOUBLE) / 100) FILTER (WHERE seller = '{n}') AS {n}" for n in PIVOT_SELLERS)
    + " FROM cells GROUP BY product, date", "prices", extra={"cells": CELLS}))
def agg_15_pivot(spark, sf_dir):
    """AGG-15: date x seller pivot of the first quote's price."""
    return P.pivot_first_price(V.prices(spark, sf_dir), PIVOT_SELLERS)


@register("join_07_grid_cells", V.with_views(
    "SELECT product, seller, date, first_c, last_c FROM grid", "prices", extra={"cells": CELLS, "grid": GRID}))
def join_07_grid_cells(spark, sf_dir):
    """JOIN-06 + JOIN-07: every cell of the date x seller grid, NULL where there is no quote."""
    return P.grid(V.prices(spark, sf_dir)).select("product", "seller", "date", "first_c", "last_c")


FILLED = """
    SELECT *, last_value(last_c IGNORE NULLS) OVER (PARTITION BY product, seller ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_c FROM grid"""


@register("join_08_filled_cells", V.with_views(
    "SELECT product, seller, date, last_c, filled_c FROM filled", "prices", extra={"cells": CELLS, "grid": GRID, "filled": FILLED}))
def join_08_filled_cells(spark, sf_dir):
    """JOIN-08 + WIN-05: every cell with the last known price carried to it."""
    return P.filled_series(V.prices(spark, sf_dir)).select("product", "seller", "date", "last_c", "filled_c")


@register("src_18_aligned_series", V.with_views("""
    SELECT product, seller, count(*) AS days, string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS dates,
           string_agg(COALESCE(CAST(first_c AS VARCHAR), ''), ',' ORDER BY date) AS prices_c
    FROM grid GROUP BY product, seller""", "prices", extra={"cells": CELLS, "grid": GRID}))
def src_18_aligned_series(spark, sf_dir):
    """SRC-18: the chart series; every seller of a product has one value or none for each of its dates."""
    day = P.aligned_series(V.prices(spark, sf_dir))
    return day.select("product", "seller", F.size("dates").cast("bigint").alias("days"), F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"),
                      F.array_join(F.transform("series", lambda c: F.coalesce(c.cast("string"), F.lit(""))), ",").alias("prices_c"))


@register("agg_16_anomaly_kpis", V.with_views("""
    SELECT product, count(*) FILTER (WHERE is_manipulation) AS anomalies,
           count(DISTINCT seller) FILTER (WHERE is_manipulation) AS flagged_sellers,
           round_even(avg(CASE WHEN is_manipulation THEN COALESCE(CAST(claimed_c - actual_c AS DOUBLE)
                 / NULLIF(CAST(claimed_c AS DOUBLE), 0) * 100, 0) END) * 10, 0) / 10 AS avg_flagged_discount_pct,
           round_even(CAST(count(*) FILTER (WHERE is_manipulation) AS DOUBLE) / count(*) * 100 * 100, 0) / 100 AS fake_rate_pct
    FROM s GROUP BY product""", "prices", extra=SCORED_CTES))
def agg_16_anomaly_kpis(spark, sf_dir):
    """AGG-16: anomaly KPIs per product."""
    return P.anomaly_kpis(_scored(spark, sf_dir))


@register("agg_17_inflation_by_seller", V.with_views("""
    SELECT product, seller, floor(CAST(sum(claimed_c - actual_c) AS DOUBLE) / count(*) / 100 * 100 + 0.5) / 100 AS avg_inflation
    FROM s WHERE is_manipulation GROUP BY product, seller""", "prices", extra=SCORED_CTES))
def agg_17_inflation_by_seller(spark, sf_dir):
    """AGG-17: mean inflation (claimed - actual) of flagged quotes per seller."""
    return P.inflation_by_seller(_scored(spark, sf_dir))


@register("agg_18_anomalies_by_weekday", V.with_views(
    "SELECT product, " + ", ".join(
        f"count(*) FILTER (WHERE is_manipulation AND dayofweek(date) = {i}) AS d{i}" for i in range(7))
    + " FROM s GROUP BY product", "prices", extra=SCORED_CTES))
def agg_18_anomalies_by_weekday(spark, sf_dir):
    """AGG-18 + FN-23: flagged quotes per weekday (Sunday = 0), zero-filled."""
    return P.anomalies_by_weekday(_scored(spark, sf_dir))


@register("agg_19_anomaly_days_by_seller", V.with_views("""
    SELECT product, seller, count(*) AS anomaly_days FROM s WHERE is_manipulation GROUP BY product, seller""",
    "prices", extra=SCORED_CTES))
def agg_19_anomaly_days_by_seller(spark, sf_dir):
    """AGG-19: days with manipulation per seller."""
    return P.anomaly_days_by_seller(_scored(spark, sf_dir))


@register("agg_25_top_manipulated", V.with_views("""
    SELECT product, fake_discounts, rank FROM (
      SELECT product, fake_discounts, CAST(row_number() OVER (ORDER BY fake_discounts DESC, product) AS INTEGER) AS rank
      FROM (SELECT product, count(*) FILTER (WHERE is_manipulation) AS fake_discounts FROM s GROUP BY product))
    WHERE rank <= 5""", "prices", extra=SCORED_CTES))
def agg_25_top_manipulated(spark, sf_dir):
    """AGG-25: top 5 products by number of fake discounts."""
    return P.top_manipulated(_scored(spark, sf_dir), 5)


@register("agg_26_price_trend", V.with_views("""
    SELECT product, CAST(date_trunc('month', date) AS DATE) AS month,
           round_even(CAST(sum(claimed_c) AS DOUBLE) / count(*) / 100 * 100, 0) / 100 AS avg_claimed,
           round_even(CAST(sum(actual_c) AS DOUBLE) / count(*) / 100 * 100, 0) / 100 AS avg_actual,
           count(*) AS quotes
    FROM prices GROUP BY product, date_trunc('month', date)""", "prices"))
def agg_26_price_trend(spark, sf_dir):
    """AGG-26: monthly claimed vs actual price per product."""
    return P.claimed_vs_actual_trend(V.prices(spark, sf_dir))


@register("agg_27_type_share", V.with_views("""
    SELECT type, quotes, round_even(CAST(quotes AS DOUBLE) / sum(quotes) OVER () * 100 * 100, 0) / 100 AS share_pct
    FROM (SELECT CASE WHEN is_manipulation THEN 'fake_discount' WHEN claimed_c > actual_c THEN 'real_discount'
                      ELSE 'no_discount' END AS type, count(*) AS quotes FROM s GROUP BY 1)""",
    "prices", extra=SCORED_CTES))
def agg_27_type_share(spark, sf_dir):
    """AGG-27: share of quotes by manipulation type."""
    return P.type_share(_scored(spark, sf_dir))


@register("prj_16_last_30_days", V.with_views("""
    SELECT product, seller, count(*) AS quotes,
           round_even(CAST(sum(actual_c) AS DOUBLE) / count(*) / 100 * 100, 0) / 100 AS avg_price
    FROM prices JOIN (SELECT product, max(date) AS last FROM prices GROUP BY product) USING (product)
    WHERE date > last - INTERVAL 30 DAY
    GROUP BY product, seller""", "prices"))
def prj_16_last_30_days(spark, sf_dir):
    """PRJ-16: the 30-day time filter, built for real."""
    return P.last_n_days(V.prices(spark, sf_dir), 30)


@register("join_11_scalar_average", V.with_views("""
    SELECT product, count(*) FILTER (WHERE actual_c > g) AS above_avg, count(*) AS quotes
    FROM prices, (SELECT CAST(sum(actual_c) AS DOUBLE) / count(*) AS g FROM prices)
    GROUP BY product""", "prices"))
def join_11_scalar_average(spark, sf_dir):
    """JOIN-11: every quote against one global average."""
    return P.above_global_average(V.prices(spark, sf_dir))


@register("join_01_prices_products", V.with_views("""
    SELECT p.date, p.product, p.seller, p.order_key, p.line_no, p.part_id, p.supp_id, c.name, c.category,
           CAST(p.actual_c AS DOUBLE) / 100 AS actual_price
    FROM prices p JOIN products c ON p.part_id = c.id""", "prices", "products"))
def join_01_prices_products(spark, sf_dir):
    """JOIN-01 + JOIN-04: quotes joined with the product catalogue."""
    j = P.with_product_names(V.prices(spark, sf_dir), V.products(spark, sf_dir))
    return j.select("date", "product", "seller", *V.PRICE_TIE, "name", "category",
                    (F.col("actual_c").cast("double") / 100).alias("actual_price"))


@register("sort_03_cheapest_quotes", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, CAST(actual_c AS DOUBLE) / 100 AS actual_price
    FROM prices ORDER BY actual_c, {TIE_SQL} LIMIT 10""", "prices"))
def sort_03_cheapest_quotes(spark, sf_dir):
    """SORT-01 + SORT-03: the 10 cheapest quotes."""
    return P.cheapest_quotes(V.prices(spark, sf_dir), 10)


@register("win_07_last_3_quotes", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, CAST(actual_c AS DOUBLE) / 100 AS actual_price, rn FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY product, seller ORDER BY date DESC, order_key DESC,
                                   line_no DESC, part_id DESC, supp_id DESC) AS INTEGER) AS rn FROM prices)
    WHERE rn <= 3""", "prices"))
def win_07_last_3_quotes(spark, sf_dir):
    """WIN-07: last k rows per series (partial top-k before the shuffle)."""
    return P.last_k_quotes(V.prices(spark, sf_dir), 3)


def _py_float_sql(c):
    return (f"CAST(({c}) // 100 AS VARCHAR) || '.' || CASE WHEN ({c}) % 100 = 0 THEN '0' "
            f"WHEN ({c}) % 10 = 0 THEN CAST((({c}) % 100) // 10 AS VARCHAR) ELSE lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0') END")


def _template_sql(t):
    import re
    pieces = re.split(r"(\{\w\})", t.replace("'", "''"))
    cols = {"{p}": "product", "{s}": "best_seller", "{b}": _py_float_sql("best_c"), "{m}": "manip_seller"}
    return " || ".join(cols.get(x, f"'{x}'") for x in pieces if x)


@register("fn_21_commentary", V.with_views(f"""
    SELECT product, CASE WHEN is_manipulated THEN {_template_sql(P.COMMENTARY_FLAGGED)}
                         ELSE {_template_sql(P.COMMENTARY_CLEAN)} END AS ai_commentary
    FROM (SELECT product, arg_min(seller, (actual_c, order_key, line_no, part_id, supp_id)) AS best_seller,
                 min(actual_c) AS best_c
          FROM prices JOIN (SELECT product, max(date) AS date FROM prices GROUP BY product) USING (product, date)
          GROUP BY product)
    JOIN (SELECT product, bool_or(is_manipulation) AS is_manipulated,
                 arg_max(seller, (date, order_key, line_no, part_id, supp_id)) FILTER (WHERE is_manipulation) AS manip_seller
          FROM s GROUP BY product) USING (product)""", "prices", extra=SCORED_CTES))
def fn_21_commentary(spark, sf_dir):
    """FN-21: commentary text by branch (manipulation found or not) for every product."""
    return P.commentary(_scored(spark, sf_dir))


@register("agg_23_rule_audit", V.with_views(f"""
    SELECT product, count(*) AS flagged, min({CONF_SQL}) AS min_confidence, max({CONF_SQL}) AS max_confidence
    FROM s WHERE is_manipulation GROUP BY product""", "prices", extra=SCORED_CTES))
def agg_23_rule_audit(spark, sf_dir):
    """AGG-23: rule audit - flagged quotes per product with their confidence range."""
    return P.rule_audit(_scored(spark, sf_dir))


@register("src_03_full_scan", V.with_views("SELECT * FROM prices", "prices"))
def src_03_full_scan(spark, sf_dir):
    """SRC-03: full scan of the price table (all rows, all columns)."""
    return V.prices(spark, sf_dir)


@register("src_04_one_series", V.with_views(f"""
    SELECT date, seller, CAST(actual_c AS DOUBLE) / 100 AS actual_price, CAST(claimed_c AS DOUBLE) / 100 AS claimed_price,
           order_key, line_no, part_id, supp_id
    FROM prices WHERE product = 'Brand#3' AND seller = 'NATION_3' ORDER BY {TIE_SQL}""", "prices"))
def src_04_one_series(spark, sf_dir):
    """SRC-04 + SORT-01: one product and seller, sorted by date (filter pushed to the scan)."""
    p = V.prices(spark, sf_dir).filter((F.col("product") == "Brand#3") & (F.col("seller") == "NATION_3"))
    return p.orderBy(*P.ORDER).select("date", "seller", (F.col("actual_c").cast("double") / 100).alias("actual_price"),
                                      (F.col("claimed_c").cast("double") / 100).alias("claimed_price"), *V.PRICE_TIE)


PCT_SQL = "COALESCE(CAST(claimed_c - actual_c AS DOUBLE) / NULLIF(CAST(claimed_c AS DOUBLE), 0) * 100, 0)"


@register("src_18_nested_result", V.with_views("""
    SELECT product, CAST(json_object('stats', stats, 'deals', deals, 'anomalies', anomalies, 'chart_data', chart) AS VARCHAR) AS json
    FROM snap JOIN dealt USING (product) JOIN flags USING (product) JOIN charts USING (product)""", "prices", extra={
    **SCORED_CTES, "cells": CELLS, "grid": GRID,
    "snap": """SELECT product, json_object('latest_date', CAST(date AS VARCHAR), 'best_seller', low.seller, 'best_price', CAST(low.actual_c AS DOUBLE) / 100,
                      'avg_price', round_even(avg_c, 0) / 100, 'discount_pct', round_even(COALESCE(CAST(low.claimed_c - low.actual_c AS DOUBLE)
                          / NULLIF(CAST(low.claimed_c AS DOUBLE), 0) * 100, 0) * 10, 0) / 10) AS stats
               FROM (SELECT product, date, arg_min({'seller': seller, 'actual_c': actual_c, 'claimed_c': claimed_c},
                                                   (actual_c, order_key, line_no, part_id, supp_id)) AS low,
                            CAST(sum(actual_c) AS DOUBLE) / count(*) / 100 * 100 AS avg_c
                     FROM prices JOIN (SELECT product, max(date) AS date FROM prices GROUP BY product) USING (product, date) GROUP BY product, date)""",
    "dealt": f"""SELECT product, to_json(list({{'seller': seller, 'date': CAST(b.date AS VARCHAR), 'current_price': CAST(b.actual_c AS DOUBLE) / 100,
                        'original_price': CAST(b.claimed_c AS DOUBLE) / 100, 'discount_pct': round_even(b.pct * 10, 0) / 10,
                        'ai_recommendation': CASE WHEN b.is_manipulation THEN 'Fake Discount - Do Not Buy' WHEN b.actual_c * n > sum_c THEN 'Wait for Drop'
                             WHEN b.actual_c * 10 * n <= sum_c * 9 THEN 'Best Buy (Highly Recommended)' ELSE 'Good Deal' END}} ORDER BY seller)) AS deals
                 FROM (SELECT product, seller, arg_min({{'date': date, 'actual_c': actual_c, 'claimed_c': claimed_c, 'pct': pct, 'is_manipulation': is_manipulation}},
                                                       (-pct, date, order_key, line_no, part_id, supp_id)) AS b
                       FROM (SELECT *, {PCT_SQL} AS pct FROM s) GROUP BY product, seller)
                 JOIN (SELECT product, sum(actual_c) AS sum_c, count(*) AS n FROM s GROUP BY product) USING (product) GROUP BY product""",
    "flags": """SELECT product, CASE WHEN bool_or(is_manipulation) THEN json_object('count', count(*) FILTER (WHERE is_manipulation),
                       'last_date', CAST(max(date) FILTER (WHERE is_manipulation) AS VARCHAR)) ELSE json_object('count', 0) END AS anomalies FROM s GROUP BY product""",
    "charts": """SELECT product, json_object('dates', to_json((SELECT list(DISTINCT CAST(p.date AS VARCHAR) ORDER BY CAST(p.date AS VARCHAR)) FROM prices p WHERE p.product = c.product)),
                        'prices', to_json(map(list(seller ORDER BY seller), list(v ORDER BY seller)))) AS chart
                 FROM (SELECT product, seller, list(CAST(first_c AS DOUBLE) / 100 ORDER BY date) AS v FROM grid GROUP BY product, seller) c GROUP BY product"""}))
def src_18_nested_result(spark, sf_dir):
    """SRC-18: nested per-product record (stats, per-seller deals, date-aligned series), as JSON."""
    return P.nested_result(_scored(spark, sf_dir)).select("product", "json")


@register("join_06_calendar_spine", V.with_views("""
    SELECT cov.product, cov.seller, calendar_days, quoted_days, COALESCE(longest_gap, 0) AS longest_gap
    FROM (SELECT product, seller, count(*) AS calendar_days, count(q) AS quoted_days FROM g GROUP BY 1, 2) cov
    LEFT JOIN (SELECT product, seller, max(n) AS longest_gap
               FROM (SELECT product, seller, grp, count(*) AS n FROM g WHERE q IS NULL GROUP BY 1, 2, 3)
               GROUP BY 1, 2) gaps USING (product, seller)""", "prices", extra={
    "cal": """SELECT s.product, s.seller, CAST(d.date AS DATE) AS date
              FROM (SELECT product, min(date) AS lo, max(date) AS hi FROM prices GROUP BY product) p
              JOIN (SELECT DISTINCT product, seller FROM prices) s USING (product),
              LATERAL (SELECT unnest(range(p.lo, p.hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date) d""",
    "g": """SELECT c.product, c.seller, c.date, q.q,
                   sum(COALESCE(q.q, 0)) OVER (PARTITION BY c.product, c.seller ORDER BY c.date
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
            FROM cal c LEFT JOIN (SELECT DISTINCT product, seller, date, 1 AS q FROM prices) q USING (product, seller, date)"""}))
def join_06_calendar_spine(spark, sf_dir):
    """JOIN-06: dense calendar spine (consecutive days x sellers x products) and coverage."""
    return P.calendar_coverage(V.prices(spark, sf_dir))
