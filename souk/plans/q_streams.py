"""Streaming queries: each runs its stream to completion (available-now trigger) over the
input files and returns the sink table. Their SQL twins are batch queries over
all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators.models import fixed_sentiment, save_models
from souk.plans.q_models import FIXED_SQL
from souk.plans.registry import register
from souk.session import scratch_path
from souk.sources import views as V
from souk.sources.versions import name_of
from souk.streaming import streams as S

TICKS_SQL = """
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS seller,
           CAST(round_even(value * 100, 0) AS BIGINT) AS actual_c,
           CAST(round_even(value * (100 + COALESCE(TRY_CAST(props ->> '$.k' AS INTEGER), 0)), 0) AS BIGINT) AS claimed_c
    FROM events"""


@register("str_01_review_ingest", V.with_views("""
    SELECT * FROM reviews WHERE product IN (SELECT p_brand FROM part)""", "reviews"))
def str_01_review_ingest(spark, sf_dir):
    """STR-01: streaming review ingest (parent check, labels, de-dup by id)."""
    return spark.read.parquet(S.run_review_ingest(spark, sf_dir)).drop("epoch", "id_range")


@register("str_01_scored_ingest")
def str_01_scored_ingest(spark, sf_dir):
    """STR-01 with scoring: the review ingest, each new review labelled by the three saved models."""
    from souk.plans.q_models import saved_sentiment_models
    stream = S.scored_ingest_stream(spark, sf_dir, saved_sentiment_models(spark, sf_dir))
    return spark.read.parquet(S.run_to_table(stream, "reviews-scored", unique="id")).drop("epoch", "id_range")


@register("str_01_fixed_scored_ingest", V.with_views("""
    SELECT r.*, f.sentiment_bert, f.sentiment_roberta, f.sentiment_lstm FROM reviews r JOIN f ON r.id = f.id
    WHERE r.product IN (SELECT p_brand FROM part)""", "reviews", extra={"f": FIXED_SQL}))
def str_01_fixed_scored_ingest(spark, sf_dir):
    """STR-01 with scoring, by saved models of given weights."""
    path = scratch_path(spark, f"models/fixed-{name_of(sf_dir)}")
    save_models(fixed_sentiment(), path)
    return spark.read.parquet(S.run_to_table(S.scored_ingest_stream(spark, sf_dir, path), "reviews-scored", unique="id")).drop("epoch", "id_range")


@register("str_02_daily_ticks", f"""
    WITH t AS ({TICKS_SQL})
    SELECT CAST(date_trunc('day', ts) AS DATE) AS day, seller, count(*) AS ticks, CAST(sum(actual_c) AS BIGINT) AS sum_c,
           min(actual_c) AS min_c, max(actual_c) AS max_c
    FROM t GROUP BY 1, 2""")
def str_02_daily_ticks(spark, sf_dir):
    """STR-02: daily tumbling tick aggregates per seller, every window."""
    path = S.run_to_table(S.daily_ticks(S.ticks_stream(spark, sf_dir)), "daily-ticks", mode="update")
    return S.newest_windows(spark.read.parquet(path)).withColumn("day", S.utc_wall_clock("day").cast("date"))


FLAGS_SQL = f"""
    WITH t AS ({TICKS_SQL}),
    r AS (SELECT *, SUM(actual_c) OVER w AS roll_sum_c, COUNT(*) OVER w AS roll_n FROM t
          WINDOW w AS (PARTITION BY seller ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT seller, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, actual_c, claimed_c,
           CAST(roll_sum_c AS BIGINT) AS roll_sum_c, roll_n,
           (claimed_c > actual_c AND actual_c * 10 * roll_n >= roll_sum_c * 9) AS is_manipulation
    FROM r"""


@register("str_02_tick_flags", FLAGS_SQL)
def str_02_tick_flags(spark, sf_dir):
    """STR-02: 7-tick rolling mean per seller with fake-discount flags over the landed ticks."""
    landed = spark.read.parquet(S.run_to_table(S.ticks_stream(spark, sf_dir), "ticks"))
    return _flag_columns(S.flags_of_ticks(landed))


@register("str_02_flags_as_they_change", FLAGS_SQL)
def str_02_flags_as_they_change(spark, sf_dir):
    """STR-02: the flags that the stream emits with each micro-batch, as last emitted: late ticks have
    changed those of the ticks after them."""
    return _flag_columns(S.newest_flags(spark, S.run_tick_flags(S.ticks_stream(spark, sf_dir))))


def _flag_columns(flags):
    return flags.select(
        "seller", "event_id", F.date_format(S.utc_wall_clock("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
        "actual_c", "claimed_c", "roll_sum_c", "roll_n", "is_manipulation")
