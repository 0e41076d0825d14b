"""CSV ingest and field normalisation (SRC-01, SRC-02, SET-01, SET-02, FN-01, FN-02,
FN-09, FN-10, FN-11, FN-27).

Files are read with an explicit schema (no inference pass over 100 TB) and normalised with
built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souk.functions.exprs import cents, col
from souk.operators.series import top_k

# The review file layout, the price file layout, the rating used for an
# unreadable rating on the parity ingest (quirk Q1) and the per-brand load cap.
REVIEW_COLUMNS = ("url", "product_name", "reviewer_name", "review_title", "review_text", "review_rating",
                  "verified_purchase", "review_date", "helpful_count", "uniq_id", "scraped_at")
REVIEW_SCHEMA = StructType([StructField(c, StringType()) for c in REVIEW_COLUMNS])
PRICE_SCHEMA = ("date DATE, product_name STRING, seller STRING, actual_price DOUBLE, "
                "claimed_original_price DOUBLE, is_manipulation BOOLEAN, real_old_price DOUBLE")
DEFAULT_RATING = 4
VERIFIED_TEXTS = ("true", "verified purchase")
DATE_PREFIX = "Reviewed in the United States on "
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_reviews(spark: SparkSession, paths: str | Sequence[str], schema: StructType = REVIEW_SCHEMA) -> DataFrame:
    """SRC-01: review CSVs (header, quoted commas and line breaks), every field as text.
    Files lacking some columns are read with their own header via ``union_sources``."""
    r = spark.read.schema(schema)
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    return r.csv(list(paths) if not isinstance(paths, str) else paths)


def read_prices(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-02: the price-history CSV, typed by schema; prices also as BIGINT cents."""
    df = spark.read.schema(PRICE_SCHEMA).option("header", "true").csv(paths)
    return (df.withColumn("actual_c", cents("actual_price"))
              .withColumn("claimed_c", cents("claimed_original_price"))
              .withColumn("real_old_c", cents("real_old_price")))


def rating_number(c) -> Column:
    """FN-01: text -> number, NULL when unreadable (ANSI cast would raise)."""
    return F.trim(col(c)).try_cast("double")


def rating_int(c, policy: str = "four") -> Column:
    """FN-02: the stored integer rating. ``four`` reproduces the reference (unreadable or
    missing -> 4, Q1); ``extract`` takes the leading number of '5.0 out of 5 stars'."""
    if policy == "four":
        return F.coalesce(rating_number(c), F.lit(float(DEFAULT_RATING))).cast("int")
    if policy == "extract":
        lead = F.regexp_extract(col(c), r"^\s*(\d+(\.\d+)?)", 1)
        return F.coalesce(F.nullif(lead, F.lit("")).try_cast("double"), F.lit(float(DEFAULT_RATING))).cast("int")
    raise ValueError(policy)


def verified_flag(c) -> Column:
    """FN-11: 'TRUE' / 'True' / 'Verified Purchase' -> true; anything else -> false."""
    return F.lower(F.trim(col(c))).isin(*VERIFIED_TEXTS)


def review_date(c) -> Column:
    """FN-09: 'Reviewed in ... on 02 May 2023' or '... on May 02, 2023' -> DATE."""
    s = F.regexp_extract(col(c), r"(\d{1,2} [A-Za-z]+ \d{4}|[A-Za-z]+ \d{1,2}, \d{4})\s*$", 1)
    s = F.nullif(s, F.lit(""))
    return F.coalesce(F.try_to_date(s, "d MMM yyyy"), F.try_to_date(s, "d MMMM yyyy"),
                      F.try_to_date(s, "MMMM d, yyyy"), F.try_to_date(s, "MMM d, yyyy"))


def helpful_count(c) -> Column:
    """FN-10: '68 people found this helpful' -> 68; empty or missing -> NULL (not 'nan', Q4)."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def normalise_reviews(raw: DataFrame, rating_policy: str = "four") -> DataFrame:
    """Typed review rows from the text columns."""
    out = raw
    if "review_rating" in raw.columns:
        out = out.withColumn("rating", rating_int("review_rating", rating_policy))
    if "verified_purchase" in raw.columns:
        out = out.withColumn("verified", verified_flag("verified_purchase"))
    if "review_date" in raw.columns:
        out = out.withColumn("date", review_date("review_date"))
    if "helpful_count" in raw.columns:
        out = out.withColumn("helpful", helpful_count("helpful_count"))
    if "scraped_at" in raw.columns:
        out = out.withColumn("scraped_ts", F.try_to_timestamp(F.col("scraped_at"), F.lit("dd/MM/yy HH:mm")))
    return out


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-01: union of sources with different columns (missing ones become NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_brands_capped(df: DataFrame, brand_patterns: dict[str, str], name_col: str, order: Sequence,
                        cap: int | None = None) -> DataFrame:
    """SET-02: split one source into brands by name pattern and union them; with ``cap``, the
    first ``cap`` rows of each in file order (``order``)."""
    parts = []
    for brand, pattern in brand_patterns.items():
        b = df.filter(F.coalesce(F.col(name_col).rlike(f"(?i){pattern}"), F.lit(False))).withColumn("brand", F.lit(brand))
        parts.append(b)
    tagged = union_sources(parts)
    return tagged if cap is None else top_k(tagged, ["brand"], list(order), cap)


def truth_label(claimed_c: str = "claimed_c", actual_c: str = "actual_c", real_old_c: str = "real_old_c") -> Column:
    """FN-27: a discounted day (claimed > actual) whose selling price is not below the true
    list price is a fake discount."""
    return (F.col(claimed_c) > F.col(actual_c)) & (F.col(actual_c) >= F.col(real_old_c))
