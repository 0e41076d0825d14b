"""Review operators: optional filters, search, paging, sentiment distributions, summaries,
leaderboards, keyword counts and related-product cards (PRJ-01..15, PRJ-18, AGG-01..11,
AGG-24, AGG-28, AGG-29, AGG-31, SORT-02, WIN-08, WIN-10, FN-24, FN-29, FN-30).

The reference ran these per product and per HTTP request; here each runs for every product
at once and the per-product answer is a filter on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import (ALL_STORES, NEGATIVE, NEUTRAL, POSITIVE, all_of, contains_ci,
                                  optional_eq, round_half_even, round_half_up)
from souk.operators.series import top_k

# Accepted model names and the column each reads (PRJ-11; 'nlptown' is an
# alias of 'bert'), and the cosmetic distribution shifts of quirk Q10.
MODEL_COLUMNS = {"bert": "sentiment_bert", "nlptown": "sentiment_bert",
                 "roberta": "sentiment_roberta", "lstm": "sentiment_lstm"}
MODEL_SHIFTS = {"roberta": (POSITIVE, NEUTRAL, 2), "lstm": (NEGATIVE, POSITIVE, 1)}

# Words never reported as keywords (common English function words).
KEYWORD_STOP_WORDS = ("the", "and", "for", "with", "that", "this", "was", "are", "from", "but",
                      "not", "you", "have", "has", "had", "its", "our", "they", "their", "been")
WORD_SPLIT = r"[^\p{L}]+"


# Fixed values of the stand-in tables: (divisor, remainder, label) of the ids where a slot's stored
# label is not the rating's. The slots must differ, or a wrong choice of column would go unseen.
STORED_LABELS = {"bert": None, "roberta": (7, 3, "Neutral"), "lstm": (11, 5, "Negative")}


def stored_label_sql(model: str) -> str:
    """The stored label of a model slot (the same text in both SQL dialects)."""
    if STORED_LABELS[model] is None:
        return "sentiment"
    n, r, label = STORED_LABELS[model]
    return f"CASE WHEN id % {n} = {r} THEN '{label}' ELSE sentiment END"


def with_model_columns(reviews: DataFrame) -> DataFrame:
    """The three stored label columns: the rating's label, but for the ids of ``STORED_LABELS``; model
    scoring (operators.models) overwrites them."""
    return reviews.withColumns({f"sentiment_{m}": F.expr(stored_label_sql(m)) for m in STORED_LABELS})


def counts_by_model(reviews: DataFrame) -> DataFrame:
    """PRJ-11 + AGG-10: count per model name, product and label, the column chosen by the name."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(label_column(m)).alias("sentiment")) for m in MODEL_COLUMNS]))
    return (reviews.select("product", named.alias("_m")).select("_m.model", "product", "_m.sentiment").filter("sentiment IS NOT NULL")
                   .groupBy("model", "product", "sentiment").agg(F.count(F.lit(1)).alias("count")))


def label_column(model_type: str) -> str:
    """PRJ-11: validated model name -> label column (no text is spliced into SQL)."""
    try:
        return MODEL_COLUMNS[model_type]
    except KeyError:
        raise ValueError(f"unknown model {model_type!r}") from None


def review_filter(search: str | None = None, rating: int | None = None, sentiment: str | None = None,
                  store: str | None = None, label_col: str = "sentiment"):
    """PRJ-03: the endpoint's optional filters as one predicate. ``rating=None`` means no
    filter (quirk Q8: unlike the reference, 0 is a real value); the store sentinel
    'All Stores' means no filter and a NULL store never matches a store filter (Q5)."""
    return all_of(
        contains_ci("review_text", search) if search else None,
        optional_eq("review_rating", rating, sentinel=None),
        optional_eq(label_col, sentiment, sentinel=None),
        optional_eq("store", store, sentinel=ALL_STORES))


def search(reviews: DataFrame, **filters) -> DataFrame:
    return reviews.filter(review_filter(**filters))


def distribution(reviews: DataFrame, label_col: str = "sentiment", keys: Sequence[str] = ("product",)) -> DataFrame:
    """AGG-02/03/04: per key, the row count, Positive/Neutral/Negative percentages (Python
    round: half-to-even) over all rows including unknown labels (Q9), and the mean rating
    of rated rows (0 when none)."""
    n = F.count(F.lit(1))
    pct = lambda s: F.rint(F.count_if(F.col(label_col) == s) / n * 100).cast("int")
    return reviews.groupBy(*keys).agg(
        n.alias("total"),
        pct(POSITIVE).alias("positive_pct"), pct(NEUTRAL).alias("neutral_pct"), pct(NEGATIVE).alias("negative_pct"),
        F.coalesce(F.try_divide(F.sum("review_rating").cast("double"), F.count("review_rating")), F.lit(0.0)).alias("avg_rating"))


def model_adjusted(dist: DataFrame, model_type: str) -> DataFrame:
    """AGG-05 (quirk Q10): the reference's cosmetic per-model shift of the distribution."""
    cols = {POSITIVE: "positive_pct", NEUTRAL: "neutral_pct", NEGATIVE: "negative_pct"}
    out = dist.withColumn("model", F.lit(model_type))
    if model_type in MODEL_SHIFTS:
        src, dst, k = MODEL_SHIFTS[model_type]
        cond = F.col(cols[src]) > 2
        out = (out.withColumn(cols[dst], F.when(cond, F.col(cols[dst]) + k).otherwise(F.col(cols[dst])))
                  .withColumn(cols[src], F.when(cond, F.col(cols[src]) - k).otherwise(F.col(cols[src]))))
    return out


def page(reviews: DataFrame, page_no: int, limit: int, keys: Sequence[str] = ("product",)) -> DataFrame:
    """SORT-02 + WIN-10 + FN-24: page ``page_no`` of each product's reviews, newest id first,
    with the running row number, the total and the page count. Pages past the end are
    empty while the total is unchanged. The ``row_number() <= k`` filter lets Spark keep
    only k rows per product per task before the shuffle."""
    hi = page_no * limit
    totals = reviews.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rows = top_k(reviews, list(keys), [F.desc("id")], hi, rank_col="row_num").filter(F.col("row_num") > hi - limit)
    return (rows.join(totals, list(keys))
                .withColumn("total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint")))


def keyset_page(reviews: DataFrame, after_id: int | None, limit: int) -> DataFrame:
    """SORT-02, deep pages: continue below the last id seen instead of counting an offset."""
    r = reviews if after_id is None else reviews.filter(F.col("id") < after_id)
    return r.orderBy(F.desc("id")).limit(limit)


def recent_split(reviews: DataFrame, n: int = 20, label_col: str = "sentiment") -> DataFrame:
    """WIN-08 + AGG-07: split of each product's last ``n`` reviews; page rounding (half-up)
    and neutral = 100 - positive - negative."""
    last = top_k(reviews, ["product"], [F.desc("id")], n)
    t = F.count(F.lit(1))
    pos = round_half_up(F.count_if(F.col(label_col) == POSITIVE) / t * 100, 0).cast("int")
    neg = round_half_up(F.count_if(F.col(label_col) == NEGATIVE) / t * 100, 0).cast("int")
    agg = last.groupBy("product").agg(t.alias("reviews"), pos.alias("positive_pct"), neg.alias("negative_pct"))
    return agg.withColumn("neutral_pct", F.lit(100) - F.col("positive_pct") - F.col("negative_pct"))


def product_summary(reviews: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """AGG-06: mean rating, review count and positive percent per product."""
    n = F.count(F.lit(1))
    return reviews.groupBy("product").agg(
        F.coalesce(F.try_divide(F.sum("review_rating").cast("double"), F.count("review_rating")), F.lit(0.0)).alias("avg_rating"),
        n.alias("total_reviews"),
        F.rint(F.count_if(F.col(label_col) == POSITIVE) / n * 100).cast("int").alias("pos_percent"))


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product").agg(F.count(F.lit(1)).alias("review_count"))


def top_products(reviews: DataFrame, k: int = 10) -> DataFrame:
    """AGG-08: the k most reviewed products."""
    return top_k(review_counts(reviews), [], [F.desc("review_count"), F.asc("product")], k, rank_col="rank")


def top_by_keyword(reviews: DataFrame, keywords: Sequence[str], k: int = 5) -> DataFrame:
    """AGG-09: top k products per keyword (case-insensitive substring of the name). The
    keyword list is a small literal table, broadcast by construction."""
    spark = reviews.sparkSession
    kw = spark.createDataFrame([(w,) for w in keywords], "keyword string")
    counts = review_counts(reviews)
    hits = counts.join(F.broadcast(kw), F.lower(F.col("product")).contains(F.lower(F.col("keyword"))))
    return top_k(hits, ["keyword"], [F.desc("review_count"), F.asc("product")], k, rank_col="rank")


def sentiment_counts(reviews: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """AGG-10: reviews per product and label (unknown labels are not a group, as in pandas)."""
    return (reviews.filter(F.col(label_col).isNotNull())
                   .groupBy("product", F.col(label_col).alias("sentiment")).agg(F.count(F.lit(1)).alias("count")))


def most_positive(reviews: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """AGG-11: products by number of positive reviews."""
    return (reviews.filter(F.col(label_col) == POSITIVE).groupBy("product")
                   .agg(F.count(F.lit(1)).alias("positive_reviews")))


def monthly_trend(reviews: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """AGG-24: monthly share of each label (computed; the reference drew fixed numbers)."""
    m = F.trunc("review_date", "month").alias("month")
    c = (reviews.filter(F.col(label_col).isNotNull())
                .groupBy(m, F.col(label_col).alias("sentiment")).agg(F.count(F.lit(1)).alias("reviews")))
    w = Window.partitionBy("month")   # one small group per month
    return c.withColumn("share_pct", round_half_even(F.col("reviews") / F.sum("reviews").over(w) * 100, 2))


def words(reviews: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Tokenise whole texts into lower-case letter runs, one row per word occurrence."""
    return reviews.select("*", F.explode(F.split(F.lower(F.col(text_col)), WORD_SPLIT)).alias("word")) \
                  .filter(F.length("word") > 0)


def top_keywords(reviews: DataFrame, k: int = 5, min_len: int = 3, label_col: str = "sentiment") -> DataFrame:
    """AGG-28: the k most frequent words per product and label, stop words removed. Word
    counts are a partial aggregate, so a hot product does not ship its raw tokens."""
    w = words(reviews.filter(F.col(label_col).isNotNull()).select("product", label_col, "review_text"))
    w = w.filter((F.length("word") >= min_len) & ~F.col("word").isin(*KEYWORD_STOP_WORDS))
    counts = w.groupBy("product", F.col(label_col).alias("sentiment"), "word").agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, ["product", "sentiment"], [F.desc("count"), F.asc("word")], k, rank_col="rank")


def overall_sentiment(reviews: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """AGG-31: the majority label per product; ties resolve Positive, Neutral, Negative."""
    c = reviews.groupBy("product").agg(
        *[F.count_if(F.col(label_col) == s).alias(s.lower()) for s in (POSITIVE, NEUTRAL, NEGATIVE)])
    best = (F.when((F.col("positive") >= F.col("neutral")) & (F.col("positive") >= F.col("negative")), F.lit(POSITIVE))
             .when(F.col("neutral") >= F.col("negative"), F.lit(NEUTRAL)).otherwise(F.lit(NEGATIVE)))
    return c.withColumn("overall", best)


def related_products(reviews: DataFrame, category_col: str = "category", k: int = 4) -> DataFrame:
    """AGG-29: for each product, up to k other products of its category (most reviewed
    first) with their counts and overall sentiment. Each category contributes its top k+1
    list only, so no product is paired with its whole category."""
    summary = overall_sentiment(reviews).join(
        reviews.groupBy("product", category_col).agg(F.count(F.lit(1)).alias("review_count")), "product")
    leaders = top_k(summary, [category_col], [F.desc("review_count"), F.asc("product")], k + 1)
    me = summary.select(F.col("product").alias("for_product"), category_col)
    cards = me.join(leaders, category_col).filter(F.col("product") != F.col("for_product"))
    return top_k(cards, ["for_product"], [F.desc("review_count"), F.asc("product")], k, rank_col="rank").select(
        "for_product", "rank", "product", "review_count", "overall")


def brand_category(product_col: str = "product", per_category: int = 5):
    """Category of a review product ('Brand#k'): brands in groups of ``per_category``."""
    k = F.regexp_extract(F.col(product_col), r"#(\d+)$", 1).cast("int")
    return F.concat(F.lit("group-"), ((k - 1) / per_category).cast("int").cast("string"))


def sentiment_class(label_col: str = "sentiment"):
    """FN-29: label -> display class."""
    c = F.col(label_col)
    return F.when(c == POSITIVE, F.lit("pos")).when(c == NEGATIVE, F.lit("neg")).otherwise(F.lit("neu"))


def shown_seller(store, best_seller, fallback: str = "Multiple Stores"):
    """FN-30: chosen store, else the best seller, else a constant."""
    return F.coalesce(F.nullif(store, F.lit("")), F.nullif(best_seller, F.lit("")), F.lit(fallback))


def profile(df: DataFrame) -> DataFrame:
    """PRJ-18: row count and NULL count per column in one pass (one row)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns])


def column_profile(df: DataFrame, sketches: bool = False) -> DataFrame:
    """PRJ-18: one row per column, from a single pass: column, type, rows, nulls, min, max (as text) and
    mean (numbers only). ``sketches`` adds the mergeable ones: approx_distinct (HyperLogLog++, 2 %
    standard error) and approx_quartiles (numbers only, rank error 1/10000)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c: t.typeName() in ("byte", "short", "integer", "long", "float", "double") or t.typeName().startswith("decimal") for c, t in types.items()}

    def facts(c):
        out = [F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
               F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.avg(c) if numeric[c] else F.lit(None)).cast("double").alias("mean")]
        if sketches:
            out += [F.approx_count_distinct(c, 0.02).alias("approx_distinct"),
                    (F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10_000) if numeric[c] else F.lit(None).cast("array<double>")).alias("approx_quartiles")]
        return F.struct(*out)

    return df.agg(F.array(*[facts(c) for c in df.columns]).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """PRJ-18: the first rows of a table in a given order (top-k in each task, no sort of the table)."""
    return df.orderBy(*order).limit(n)
