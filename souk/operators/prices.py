"""Price-series operators: rolling means, the fake-discount rule, anomaly reports, snapshot
stats, spines, pivots and KPIs (WIN-01..11, JOIN-06..09, JOIN-11, AGG-12..19, AGG-25..27,
FN-13..15, FN-19, FN-23, PRJ-16, PRJ-19).

Everything runs for all products and sellers in one job; the reference ran one HTTP request
per product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import (FAKE_FLAG_SCORE, FAKE_RATIO_DEN, FAKE_RATIO_NUM, ROLLING_ROWS,
                                  checksum_confidence, discount_pct, money, round_half_even,
                                  weekday_sun0)
from souk.operators import series
from souk.operators.series import block_cuts, day_counts, forward_fill, rolling_rows, top_k
from souk.sources.tables import table_path
from souk.sources.versions import file_state, name_of, reused
from souk.sources.views import PRICE_TIE, SERIES
from souk.sources.views import prices as price_view

ORDER = ("date",) + PRICE_TIE


def price_tables(spark, sf_dir: str) -> list[str]:
    """The files that the price view is made from."""
    return [table_path(sf_dir, t) for t in ("lineitem", "part", "supplier", "nation")]


def price_cuts(spark, sf_dir: str, keys=SERIES) -> DataFrame:
    """Where the series of a folder's price table are cut into blocks of equal volume: a statistic of
    the table, counted once for each state of its files and stored (``sources.versions``)."""
    def count():
        # Only the place of each quote is read: the price columns are pruned from the scan.
        return block_cuts(day_counts(price_view(spark, sf_dir), list(keys), list(ORDER)), list(keys))
    name = f"cuts-{'-'.join(keys)}-{series.BLOCK_ROWS}-{name_of(sf_dir)}"
    return reused(spark, name, file_state(spark, *price_tables(spark, sf_dir)), count)


def scored_quotes(spark, sf_dir: str) -> DataFrame:
    """``scored`` over the whole price table of a folder."""
    return scored(price_view(spark, sf_dir), price_cuts(spark, sf_dir))


def with_rolling_mean(prices: DataFrame, n: int = ROLLING_ROWS, keys=SERIES, cuts: DataFrame | None = None) -> DataFrame:
    """WIN-01/02/03: rolling mean of ``actual_c`` over the last ``n`` rows of each series
    (min_periods=1). Adds ``roll_sum_c`` and ``roll_n`` (exact integers) and
    ``rolling_avg`` (DOUBLE, in money units). ``cuts``: see ``rolling_rows``."""
    out = rolling_rows(prices, list(keys), list(ORDER), n, {"roll_sum_c": "actual_c"}, count_col="roll_n", cuts=cuts)
    return out.withColumn("rolling_avg", out.roll_sum_c.cast("double") / out.roll_n / 100)


def fake_discount_flag() -> F.Column:
    """FN-14: claimed > actual AND actual >= 0.9 x rolling mean, in exact integer arithmetic:
    10 * actual * n >= 9 * sum."""
    return ((F.col("claimed_c") > F.col("actual_c")) &
            (F.col("actual_c") * FAKE_RATIO_DEN * F.col("roll_n") >= F.col("roll_sum_c") * FAKE_RATIO_NUM))


def scored(prices: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Rolling mean + rule flag + score for every quote (the price analysis, all products)."""
    r = with_rolling_mean(prices, cuts=cuts)
    flag = fake_discount_flag()
    return (r.withColumn("is_manipulation", flag)
             .withColumn("anomaly_score", F.when(flag, F.lit(FAKE_FLAG_SCORE)).otherwise(F.lit(0.0)))
             .withColumn("discount_claim", money(F.col("claimed_c") - F.col("actual_c")))
             .withColumn("actual_price", money("actual_c"))
             .withColumn("claimed_price", money("claimed_c")))


def fake_discounts(scored_df: DataFrame) -> DataFrame:
    """The flagship: every quote the fake-discount rule flags, with its rolling mean."""
    return scored_df.filter("is_manipulation").select(
        "product", "seller", "date", *PRICE_TIE, "actual_price", "claimed_price", "discount_claim",
        "rolling_avg", "anomaly_score")


def anomaly_report(scored_df: DataFrame) -> DataFrame:
    """PRJ-19 / FN-19: flagged rows with date, seller, claimed, actual and the checksum
    confidence, newest first (ordering is applied by the caller's sink; rows carry the keys)."""
    return scored_df.filter("is_manipulation").select(
        "product", "date", "seller", *PRICE_TIE,
        round_half_even(money("claimed_c"), 2).alias("claimed_price"),
        round_half_even(money("actual_c"), 2).alias("actual_price"),
        round_half_even(checksum_confidence("date", "seller"), 1).alias("confidence"))


def latest_snapshot(prices: DataFrame) -> DataFrame:
    """WIN-06 + AGG-12: per product, the quotes on its latest date; mean price, the best
    (lowest) price and the seller holding it, and that quote's discount %.

    Two aggregates over one scan: per product and day, then ``max_by`` per product."""
    best = F.min_by(F.struct("seller", "claimed_c", "actual_c"), F.struct("actual_c", *PRICE_TIE)).alias("_best")
    per_day = prices.groupBy("product", "date").agg(
        F.sum("actual_c").alias("_sum_c"), F.count(F.lit(1)).alias("quotes"), best)
    d = per_day.groupBy("product").agg(
        F.max_by(F.struct("date", "_sum_c", "quotes", "_best"), F.col("date")).alias("d"))
    return d.select(
        "product", F.col("d.date").alias("latest_date"),
        F.col("d._best.seller").alias("best_seller"),
        money("d._best.actual_c").alias("best_price"),
        round_half_even(F.col("d._sum_c").cast("double") / F.col("d.quotes") / 100, 2).alias("avg_price"),
        round_half_even(discount_pct("d._best.claimed_c", "d._best.actual_c"), 1).alias("discount_pct"),
        F.col("d.quotes").alias("quotes"))


def flag_summary(scored_df: DataFrame) -> DataFrame:
    """AGG-13: per product, whether any quote is flagged and the seller of the last flagged
    quote in series order (the reference reports the last one it saw)."""
    return scored_df.groupBy("product").agg(
        F.bool_or("is_manipulation").alias("is_manipulated"),
        F.max_by(F.when(F.col("is_manipulation"), F.col("seller")),
                 F.when(F.col("is_manipulation"), F.struct(*ORDER))).alias("manip_seller"),
        F.sum(F.col("is_manipulation").cast("int")).cast("bigint").alias("flagged"))


# ---------------------------------------------------------------------------------------
# Aggregations over scored quotes (the anomaly list and the price series of each product).

def mean_c(c) -> F.Column:
    """Exact mean of a BIGINT cents column: integer sum / count, one division."""
    return F.sum(c).cast("double") / F.count(c)


def rolling_mean_long(prices: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """WIN-03 + FN-15 (rule part): 14-row rolling mean per product across its sellers and the
    confirming rule claimed > actual AND actual >= 0.9 x mean14."""
    from souk.functions.exprs import ROLLING_ROWS_LONG
    r = rolling_rows(prices, ["product"], list(ORDER), ROLLING_ROWS_LONG, {"roll14_c": "actual_c"},
                     count_col="roll14_n", cuts=cuts)
    return (r.withColumn("rolling_avg_14", r.roll14_c.cast("double") / r.roll14_n / 100)
             .withColumn("rule_flag", (F.col("claimed_c") > F.col("actual_c")) &
                         (F.col("actual_c") * FAKE_RATIO_DEN * F.col("roll14_n") >= F.col("roll14_c") * FAKE_RATIO_NUM)))


def discounts(prices: DataFrame) -> DataFrame:
    """FN-13 per quote: discount amount and percent (0 when the list price is 0)."""
    return prices.select("product", "seller", "date", *PRICE_TIE,
                         money(F.col("claimed_c") - F.col("actual_c")).alias("discount_amount"),
                         round_half_even(discount_pct("claimed_c", "actual_c"), 1).alias("discount_pct"))


def dates_and_sellers(prices: DataFrame) -> DataFrame:
    """AGG-14 / SET-03: distinct dates and the sorted distinct sellers of each product."""
    return prices.groupBy("product").agg(
        F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("seller")), ",").alias("sellers"),
        F.countDistinct("seller").alias("n_sellers"))


def cell_quotes(prices: DataFrame) -> DataFrame:
    """WIN-09: per (product, seller, date) the first and the last quote in tie order (the
    reference's grid keeps the first, its fill keeps the last)."""
    return prices.groupBy("product", "seller", "date").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.min_by("actual_c", F.struct(*PRICE_TIE)).alias("first_c"),
        F.max_by("actual_c", F.struct(*PRICE_TIE)).alias("last_c"))


def grid(prices: DataFrame) -> DataFrame:
    """JOIN-06 + JOIN-07: each product's distinct dates x its distinct sellers, with the
    day's first and last quote (NULL when the seller has no quote that day).
    The quotes are read once: cells are gathered by day, days by product, and both are dealt out again
    with the product's sellers. What is gathered is bounded by calendar days x sellers, not by the number
    of rows. A quote without a seller has no place in the grid."""
    cells = cell_quotes(prices.filter(F.col("seller").isNotNull()))
    days = cells.groupBy("product", "date").agg(F.collect_list(F.struct("seller", F.struct("n_quotes", "first_c", "last_c").alias("cell"))).alias("_cells"))
    whole = days.groupBy("product").agg(
        F.collect_list(F.struct("date", "_cells")).alias("_days"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("_cells", lambda c: c["seller"])))).alias("_sellers"))
    by_day = whole.select("product", "_sellers", F.explode("_days").alias("_d")).select(
        "product", "_sellers", F.col("_d.date").alias("date"), F.map_from_entries("_d._cells").alias("_map"))
    return by_day.select("product", "date", "_map", F.explode("_sellers").alias("seller")).select(
        "product", "seller", "date", F.try_element_at("_map", F.col("seller")).alias("_c")).select("product", "seller", "date", "_c.*")


def aligned_series(prices: DataFrame) -> DataFrame:
    """SRC-18: per product and seller, the product's dates and the seller's price (NULL without a
    quote) on each: arrays of equal length, bounded by the calendar."""
    cells = F.array_sort(F.collect_list(F.struct("date", "first_c"))).alias("cells")
    return grid(prices).groupBy("product", "seller").agg(cells).select(
        "product", "seller", F.col("cells.date").alias("dates"), F.col("cells.first_c").alias("series"))


def grid_summary(prices: DataFrame) -> DataFrame:
    g = grid(prices)
    return g.groupBy("product", "seller").agg(
        F.count(F.lit(1)).alias("grid_days"),
        F.count("first_c").alias("quoted_days"),
        (F.count(F.lit(1)) - F.count("first_c")).alias("empty_cells"),
        F.sum("first_c").alias("sum_first_c"))


def filled_series(prices: DataFrame) -> DataFrame:
    """JOIN-08 / WIN-05: the grid with each seller's last known price carried forward."""
    return forward_fill(grid(prices), ["product", "seller"], ["date"], "last_c", "filled_c")


def fill_summary(prices: DataFrame) -> DataFrame:
    f = filled_series(prices)
    return f.groupBy("product", "seller").agg(
        F.count("filled_c").alias("filled_cells"),
        (F.count(F.lit(1)) - F.count("filled_c")).alias("leading_nulls"),
        F.sum("filled_c").alias("sum_filled_c"),
        money(F.max_by("filled_c", "date")).alias("last_price"))


def pivot_first_price(prices: DataFrame, sellers: list[str]) -> DataFrame:
    """AGG-15: date x seller grid of the first quote's price, one column per seller.
    ``sellers`` is the explicit value list (a bounded dimension), so no extra job runs; a quote of
    any other seller has no column and fails the job."""
    stranger = F.raise_error(F.concat(F.lit("the pivot has no column for seller "), F.coalesce("seller", F.lit("NULL"))))
    cells = cell_quotes(prices).withColumn("price", money("first_c"))
    cells = cells.withColumn("seller", F.when(F.col("seller").isin(sellers), F.col("seller")).otherwise(stranger))
    return cells.groupBy("product", "date").pivot("seller", sellers).agg(F.first("price"))


def anomaly_kpis(scored_df: DataFrame) -> DataFrame:
    """AGG-16: anomaly count, distinct flagged sellers, mean discount % of the flagged quotes
    and the share of quotes flagged, per product."""
    flagged = F.col("is_manipulation")
    pct = discount_pct("claimed_c", "actual_c")
    return scored_df.groupBy("product").agg(
        F.count_if(flagged).alias("anomalies"),
        F.countDistinct(F.when(flagged, F.col("seller"))).alias("flagged_sellers"),
        round_half_even(F.avg(F.when(flagged, pct)), 1).alias("avg_flagged_discount_pct"),
        round_half_even(F.count_if(flagged) / F.count(F.lit(1)) * 100, 2).alias("fake_rate_pct"))


def inflation_by_seller(scored_df: DataFrame) -> DataFrame:
    """AGG-17: mean (claimed - actual) of the flagged quotes per seller, 2 places half-up."""
    from souk.functions.exprs import round_half_up
    f = scored_df.filter("is_manipulation")
    return f.groupBy("product", "seller").agg(
        round_half_up(mean_c(F.col("claimed_c") - F.col("actual_c")) / 100, 2).alias("avg_inflation"))


def anomalies_by_weekday(scored_df: DataFrame) -> DataFrame:
    """AGG-18: flagged quotes per weekday (Sunday = 0), zero-filled: seven count columns per
    product, so no weekday spine has to be joined."""
    wd = weekday_sun0("date")
    flagged = F.col("is_manipulation")
    return scored_df.groupBy("product").agg(
        *[F.count_if(flagged & (wd == i)).alias(f"d{i}") for i in range(7)])


def anomaly_days_by_seller(scored_df: DataFrame) -> DataFrame:
    """AGG-19: flagged quotes per seller."""
    return scored_df.filter("is_manipulation").groupBy("product", "seller").agg(
        F.count(F.lit(1)).alias("anomaly_days"))


def top_manipulated(scored_df: DataFrame, k: int = 5) -> DataFrame:
    """AGG-25: the k products with most flagged quotes."""
    counts = scored_df.groupBy("product").agg(F.count_if("is_manipulation").alias("fake_discounts"))
    return top_k(counts, [], [F.desc("fake_discounts"), F.asc("product")], k, rank_col="rank")


def claimed_vs_actual_trend(prices: DataFrame) -> DataFrame:
    """AGG-26: monthly mean claimed and actual price per product."""
    m = F.trunc("date", "month").alias("month")
    return prices.groupBy("product", m).agg(
        round_half_even(mean_c("claimed_c") / 100, 2).alias("avg_claimed"),
        round_half_even(mean_c("actual_c") / 100, 2).alias("avg_actual"),
        F.count(F.lit(1)).alias("quotes"))


def discount_type(scored_col="is_manipulation") -> F.Column:
    return (F.when(F.col(scored_col), F.lit("fake_discount"))
             .when(F.col("claimed_c") > F.col("actual_c"), F.lit("real_discount"))
             .otherwise(F.lit("no_discount")))


def type_share(scored_df: DataFrame) -> DataFrame:
    """AGG-27: share of quotes by manipulation type (three rows)."""
    by = scored_df.groupBy(discount_type().alias("type")).agg(F.count(F.lit(1)).alias("quotes"))
    total = by.agg(F.sum("quotes")).scalar()     # over the three aggregated rows
    return by.withColumn("share_pct", round_half_even(F.col("quotes") / total * 100, 2))


def last_n_days(prices: DataFrame, days: int = 30) -> DataFrame:
    """PRJ-16: quotes within the last ``days`` days of each product's history. Quotes are
    first summed per (product, seller, day); the product's last day is a window over that
    small table (bounded by calendar days x sellers), so the quotes are not joined back."""
    daily = prices.groupBy("product", "seller", "date").agg(F.sum("actual_c").alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("product")
    recent = daily.withColumn("_last", F.max("date").over(w)).filter(F.col("date") > F.date_sub("_last", days))
    return recent.groupBy("product", "seller").agg(
        F.sum("_n").alias("quotes"),
        round_half_even(F.sum("_s").cast("double") / F.sum("_n") / 100, 2).alias("avg_price"))


def above_global_average(prices: DataFrame) -> DataFrame:
    """JOIN-11: every quote against one global mean (a scalar subquery: computed once,
    its single value shipped to every task)."""
    g = prices.agg(mean_c("actual_c").alias("_gavg")).scalar()
    j = prices.withColumn("_above", F.col("actual_c") > g)
    return j.groupBy("product").agg(
        F.count_if("_above").alias("above_avg"),
        F.count(F.lit(1)).alias("quotes"))


def with_product_names(prices: DataFrame, products: DataFrame) -> DataFrame:
    """JOIN-01 / JOIN-04: quotes joined to the product catalogue; unmatched quotes drop.
    The catalogue grows with the data, so the join strategy is left to the planner."""
    cat = products.select(F.col("id").alias("part_id"), "name", "category")
    return prices.join(cat, "part_id")


def cheapest_quotes(prices: DataFrame, k: int = 10) -> DataFrame:
    """SORT-03: the k cheapest quotes (TakeOrderedAndProject: partial top-k per task)."""
    return prices.orderBy(F.asc("actual_c"), *[F.asc(c) for c in ORDER]).limit(k).select(
        "product", "seller", "date", *PRICE_TIE, money("actual_c").alias("actual_price"))


def last_k_quotes(prices: DataFrame, k: int = 3) -> DataFrame:
    """WIN-07: the k most recent quotes of every series."""
    order = [F.desc(c) for c in ORDER]
    return top_k(prices, list(SERIES), order, k, rank_col="rn").select(
        "product", "seller", "date", *PRICE_TIE, money("actual_c").alias("actual_price"), "rn")


# The reference's analysis commentary (two branches), verbatim.
COMMENTARY_FLAGGED = ("{p} ürünü son 30 gün içinde en uygun olarak {s} üzerinde satılmıştır (Fiyat: ${b}). "
                      "{m} üzerindeki kampanya ise geçmiş fiyat verilerine göre sahte indirim (fiyat manipülasyonu) "
                      "olarak işaretlenmiştir.")
COMMENTARY_CLEAN = ("{p} ürünü son 30 gün içinde en uygun olarak {s} üzerinde satılmıştır (Fiyat: ${b}). "
                    "Tüm satıcı firmalar normal fiyat marjları sergilemiş olup, herhangi bir manipülasyon "
                    "tespit edilmemiştir.")


def _fill(template: str, **cols) -> F.Column:
    """Render a ``{name}`` template with columns (concat of literal pieces and columns)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def commentary(scored_df: DataFrame) -> DataFrame:
    """FN-21: the per-product commentary: the best price of the latest day and the seller of the last
    flagged quote, from one pass over the quotes (by day, then by product)."""
    from souk.functions.exprs import py_float_text
    flagged = F.when(F.col("is_manipulation"), F.struct(*ORDER, "seller"))
    days = scored_df.groupBy("product", "date").agg(F.min(F.struct("actual_c", *PRICE_TIE, "seller")).alias("best"), F.max(flagged).alias("flagged"))
    j = days.groupBy("product").agg(F.max(F.struct("date", "best")).alias("at"), F.max("flagged").alias("flagged"))
    args = dict(p=F.col("product"), s=F.col("at.best.seller"), b=py_float_text("at.best.actual_c"))
    text = F.when(F.col("flagged").isNotNull(), _fill(COMMENTARY_FLAGGED, m=F.col("flagged.seller"), **args)) \
            .otherwise(_fill(COMMENTARY_CLEAN, **args))
    return j.select("product", text.alias("ai_commentary"))


def rule_audit(scored_df: DataFrame) -> DataFrame:
    """AGG-23: how many quotes the rule flags per product, with their confidence range."""
    f = scored_df.filter("is_manipulation").withColumn("_conf", round_half_even(checksum_confidence("date", "seller"), 1))
    return f.groupBy("product").agg(F.count(F.lit(1)).alias("flagged"), F.min("_conf").alias("min_confidence"),
                                    F.max("_conf").alias("max_confidence"))


def nested_result(scored_df: DataFrame) -> DataFrame:
    """SRC-18: one nested record per product, and its JSON text: the latest snapshot (``stats``), each
    seller's best deal with its advice, and the chart, which has the product's ``dates`` once and for
    each seller a series of that length (NULL on days without a quote). The flagged quotes are
    unbounded, so the record has their number and the day of the last one; the list itself is the
    anomaly report (PRJ-19), under the same product.

    One pass over the quotes makes cells (product, seller, day); days and then products are made of
    cells, so everything collected is bounded by calendar days x sellers.
    """
    from souk.operators.deals import advice
    rows = scored_df.withColumn("_pct", discount_pct("claimed_c", "actual_c"))
    deal = F.struct((-F.col("_pct")).alias("k"), "date", *PRICE_TIE, "claimed_c", "actual_c", "_pct", "is_manipulation")
    cells = rows.groupBy("product", "seller", "date").agg(
        F.min(F.struct(*PRICE_TIE, "actual_c")).alias("_first"), F.min(deal).alias("_deal"),
        F.min(F.struct("actual_c", *PRICE_TIE, "claimed_c")).alias("_low"),
        F.sum("actual_c").alias("_s"), F.count(F.lit(1)).alias("_n"), F.count_if("is_manipulation").alias("_flagged"))
    series = Window.partitionBy("product", "seller")
    cells = cells.withColumns({"_deal": F.min("_deal").over(series), "_last": F.max("date").over(series)})
    days = cells.groupBy("product", "date").agg(
        F.collect_list(F.struct("seller", F.col("_first.actual_c").alias("c"))).alias("quotes"),
        F.collect_list(F.when(F.col("date") == F.col("_last"), F.struct("seller", "_deal"))).alias("deals"),
        F.min(F.struct("_low", "seller")).alias("low"), F.sum("_s").alias("s"), F.sum("_n").alias("n"), F.sum("_flagged").alias("flagged"))
    one = days.groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("date", "quotes"))).alias("days"), F.array_sort(F.flatten(F.collect_list("deals"))).alias("deals"),
        F.max(F.struct("date", "low", "s", "n")).alias("at"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("flagged").alias("flagged"),
        F.max(F.when(F.col("flagged") > 0, F.col("date"))).alias("last_flagged"))
    sellers = F.transform("deals", lambda d: d["seller"])
    by_seller = F.transform("days", lambda d: F.map_from_entries(d["quotes"]))
    mapped = one.select("*", sellers.alias("sellers"), by_seller.alias("maps"))
    claimed, best = F.col("at.low._low.claimed_c"), F.col("at.low._low.actual_c")
    stats = F.struct(F.col("at.date").cast("string").alias("latest_date"), F.col("at.low.seller").alias("best_seller"), money(best).alias("best_price"),
                     round_half_even(F.col("at.s").cast("double") / F.col("at.n") / 100, 2).alias("avg_price"),
                     round_half_even(discount_pct(claimed, best), 1).alias("discount_pct"))

    def shown(d):
        q = d["_deal"]
        a = advice(q["actual_c"], q["is_manipulation"], F.col("s"), F.col("n"))
        return F.struct(d["seller"].alias("seller"), q["date"].cast("string").alias("date"), money(q["actual_c"]).alias("current_price"),
                        money(q["claimed_c"]).alias("original_price"), round_half_even(q["_pct"], 1).alias("discount_pct"), a[0].alias("ai_recommendation"))

    chart = F.struct(F.transform("days", lambda d: d["date"].cast("string")).alias("dates"), F.map_from_arrays("sellers", F.transform(
        "sellers", lambda x: F.transform("maps", lambda m: money(F.try_element_at(m, x))))).alias("prices"))
    flagged = F.struct(F.col("flagged").alias("count"), F.col("last_flagged").cast("string").alias("last_date"))
    out = mapped.select("product", stats.alias("stats"), F.transform("deals", shown).alias("deals"), flagged.alias("anomalies"), chart.alias("chart_data"))
    return out.withColumn("json", F.to_json(F.struct("stats", "deals", "anomalies", "chart_data")))


def calendar_spine(prices: DataFrame) -> DataFrame:
    """JOIN-06 (calendar form): every consecutive day from each product's first to its last
    quote, for each of its sellers (``sequence`` + ``explode``; bounded by calendar days x
    sellers per product, not by rows)."""
    spans = prices.groupBy("product").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"),
                                          F.collect_set("seller").alias("_sellers"))
    return (spans.select("product", F.explode("_sellers").alias("seller"), "_lo", "_hi")
                 .select("product", "seller", F.explode(F.sequence("_lo", "_hi")).alias("date")))


def calendar_coverage(prices: DataFrame) -> DataFrame:
    """Per (product, seller): calendar days in the product's span, days with a quote, and the
    longest run of consecutive days without one. Gaps are the steps between a seller's distinct days
    (and to the ends of the span), so no spine is built."""
    days = prices.select("product", "seller", "date").distinct()
    along = Window.partitionBy("product", "seller").orderBy("date")
    span = Window.partitionBy("product")
    stepped = days.withColumns({"_lo": F.min("date").over(span), "_hi": F.max("date").over(span)}).withColumn(
        "_gap", F.date_diff("date", F.lag("date").over(along)) - 1)
    seller = stepped.groupBy("product", "seller").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("date").alias("_from"), F.max("date").alias("_to"),
        F.count(F.lit(1)).alias("quoted_days"), F.max("_gap").alias("_gap"))
    return seller.select("product", "seller", (F.date_diff("_hi", "_lo") + 1).cast("bigint").alias("calendar_days"), "quoted_days",
                         F.greatest(F.coalesce("_gap", F.lit(0)), F.date_diff("_from", "_lo"), F.date_diff("_hi", "_to")).cast("bigint").alias("longest_gap"))
